import csv
import hashlib
import io
import random

import pytest

from matchloom.operators import profile
from matchloom.plans import workflows
from matchloom.schema import ID_COLUMNS, SOURCE_COLUMNS, TRUTH_COLUMNS, DataFormatError
from matchloom.sources import tsv

HEADER = "\t".join(SOURCE_COLUMNS) + "\n"
GOOD = HEADER + "S1-1\tNA\t\tIndia\n" + 'S1-2\t  \t"a ""tab""\there\nand line"\tUS\n' + "S1-3\tÉcole\tx\tUS\n"


def put(tmp_path, text, name="a.tsv"):
    path = tmp_path / name
    path.write_text(text, encoding="utf-8")
    return str(path)


def test_texts_are_kept_as_they_are(spark, tmp_path):
    rows = {r.entity_id: r for r in tsv.read_tsv(spark, put(tmp_path, GOOD), SOURCE_COLUMNS).collect()}
    assert (rows["S1-1"].business_name, rows["S1-1"].business_address) == ("NA", "")
    assert rows["S1-2"].business_name == "  "
    assert rows["S1-2"].business_address == 'a "tab"\there\nand line'


@pytest.mark.parametrize(
    "text",
    ["", HEADER.replace("\t", ","), HEADER.replace("country", "Country"), "entity_id\n", "country\t" + HEADER, HEADER + "S1-1\ta\tb\n", HEADER + "S1-1\ta\tb\tc\td\n", HEADER + "\n", HEADER + "S1-1\ta\tb\tc\n\nS1-2\ta\tb\tc\n", HEADER + 'S1-1\t"a\tb\tc\n'],
)
def test_faults_are_refused(spark, tmp_path, text):
    with pytest.raises(DataFormatError):
        tsv.read_tsv(spark, put(tmp_path, text), SOURCE_COLUMNS)


@pytest.fixture
def small_splits(spark):
    """Splits of a few bytes, so that rows cross them."""
    names = {"spark.sql.files.maxPartitionBytes": "37", "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}
    for k, v in names.items():
        spark.conf.set(k, v)
    yield
    for k in names:
        spark.conf.unset(k)


def by_csv(text):
    return [tuple(r) for r in csv.reader(io.StringIO(text, newline=""), delimiter="\t", strict=True)]


FIELDS = ["", "a", "NA", '"q"', '"a\nb"', '"\n\n"', '"x ""y"" z"', 'in"side', '"tab\there"', "é", '""', '"long\n' + "line " * 12 + '\n"', "5\" pipe", '""""']


@pytest.mark.parametrize("seed", range(8))
def test_splits_read_as_one_file(spark, tmp_path, small_splits, seed):
    rng = random.Random(seed)
    fields = FIELDS if seed % 2 else [f for f in FIELDS if '"' not in f]
    text = HEADER + "".join("\t".join(rng.choice(fields) for _ in SOURCE_COLUMNS) + rng.choice(["\n", "\r\n"] if seed > 5 else ["\n"]) for _ in range(25))
    text = text.removesuffix("\n") if seed == 3 else text
    rows = tsv.read_tsv(spark, put(tmp_path, text), SOURCE_COLUMNS)
    assert sorted(map(tuple, rows.collect())) == sorted(by_csv(text)[1:])
    assert tsv._lines(spark, str(tmp_path / "a.tsv")).rdd.getNumPartitions() > 5
    assert sorted(map(tuple, tsv.read_tsv(spark, put(tmp_path, text), SOURCE_COLUMNS, limit=7).collect())) == sorted(by_csv(text)[1:8])


@pytest.mark.parametrize("row, line", [("a\tb\tc", 32), ('"a"b\tc\td\te', 32), ("", 32), ('"x\ny"\ta\tb\tc\td', 33), ('a\tb\tc\t"d', 42)])
def test_faults_are_told_with_their_line(spark, tmp_path, small_splits, row, line):
    good = "S1-1\ta\tb\tc\n"
    text = HEADER + good * 30 + row + "\n" + good * 10
    with pytest.raises(DataFormatError, match=f"line {line}:"):
        tsv.read_tsv(spark, put(tmp_path, text), SOURCE_COLUMNS)


def test_state_after_lines_is_that_of_the_csv_reader():
    rng = random.Random(1)
    for _ in range(3000):
        line = "".join(rng.choices('"\ta', k=rng.randrange(0, 9)))
        for state in (tsv.OUTSIDE, tsv.INSIDE):
            try:
                rows = list(csv.reader(io.StringIO(("" if state == tsv.OUTSIDE else '"\n') + line + '\nX', newline=""), delimiter="\t", strict=True))
            except csv.Error as e:
                if "expected after" in str(e):
                    continue
                rows = []
            assert (tsv.state_after(line, state) == tsv.OUTSIDE) == (len(rows) > 1 and rows[-1] == ["X"]), (line, state)


def test_folders_of_files(spark, tmp_path):
    for k, text in enumerate((GOOD, HEADER, HEADER + "S1-9\tx\ty\tz\n")):
        put(tmp_path, text, f"part{k}.tsv")
    assert tsv.read_tsv(spark, str(tmp_path), SOURCE_COLUMNS).count() == 4
    put(tmp_path, HEADER + "S1-8\tx\n", "part9.tsv")
    with pytest.raises(DataFormatError, match="part9.*line 2"):
        tsv.read_tsv(spark, str(tmp_path), SOURCE_COLUMNS)


def test_many_tasks_write_one_file(spark, tmp_path):
    rows = spark.range(5000).selectExpr("concat('S1-', lpad(id, 5, '0')) as source1_entity_id").repartition(7)
    path = str(tmp_path / "ids.tsv")
    tsv.write_tsv(rows, path, ID_COLUMNS, ID_COLUMNS[0])
    assert (tmp_path / "ids.tsv").read_text() == "source1_entity_id\n" + "".join(f"S1-{i:05d}\n" for i in range(5000))
    assert [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["ids.tsv"]
    found = tsv.fingerprint(spark, path)
    assert found == {"sha256": hashlib.sha256((tmp_path / "ids.tsv").read_bytes()).hexdigest(), "bytes": (tmp_path / "ids.tsv").stat().st_size}
    tsv.write_parts(rows, str(tmp_path / "parts"), ID_COLUMNS, ID_COLUMNS[0])
    assert len(list((tmp_path / "parts").glob("part-*"))) >= 1


def test_header_alone_is_an_empty_table(spark, tmp_path):
    rows = tsv.read_tsv(spark, put(tmp_path, HEADER), SOURCE_COLUMNS)
    assert rows.count() == 0 and rows.columns == list(SOURCE_COLUMNS)


def test_limit_stops_before_later_faults(spark, tmp_path):
    path = put(tmp_path, HEADER + "S1-1\ta\tb\tc\n" + "broken\n")
    assert tsv.read_tsv(spark, path, SOURCE_COLUMNS, limit=1).count() == 1
    with pytest.raises(DataFormatError, match="line 3"):
        tsv.read_tsv(spark, path, SOURCE_COLUMNS)


def test_small_table_has_a_bound(spark, tmp_path):
    path = put(tmp_path, HEADER + "".join(f"S1-{i}\ta\tb\tc\n" for i in range(5)))
    assert tsv.small_table(spark, path, SOURCE_COLUMNS, 5).count() == 5
    with pytest.raises(DataFormatError):
        tsv.small_table(spark, path, SOURCE_COLUMNS, 4)


def test_written_files_read_back(spark, tmp_path):
    rows = spark.createDataFrame([("S1-b", 'x\t"y"'), ("S1-a", "")], ", ".join(f"{c} string" for c in TRUTH_COLUMNS))
    path = str(tmp_path / "out.tsv")
    tsv.write_tsv(rows, path, TRUTH_COLUMNS, TRUTH_COLUMNS[0])
    assert (tmp_path / "out.tsv").read_text() == "source1_entity_id\tmatched_entity_ids\nS1-a\t\nS1-b\t\"x\t\"\"y\"\"\"\n"
    assert sorted(map(tuple, tsv.read_tsv(spark, path, TRUTH_COLUMNS).collect())) == [("S1-a", ""), ("S1-b", 'x\t"y"')]
    with pytest.raises(FileExistsError):
        tsv.write_tsv(rows, path, TRUTH_COLUMNS)


def test_missing_values_and_other_columns_are_not_written(spark, tmp_path):
    with pytest.raises(DataFormatError):
        tsv.write_tsv(spark.createDataFrame([(None,)], "source1_entity_id string"), str(tmp_path / "x"), ID_COLUMNS)
    with pytest.raises(DataFormatError):
        tsv.write_tsv(spark.createDataFrame([(1,)], "source1_entity_id int"), str(tmp_path / "x"), ID_COLUMNS)


def test_a_folder_appears_whole_or_not(spark, tmp_path):
    place = str(tmp_path / "result")
    with pytest.raises(RuntimeError):
        with tsv.Staged(spark, place) as staged:
            tsv.write_text(spark, f"{staged}/a.txt", "x")
            raise RuntimeError
    assert not list(tmp_path.iterdir())
    with tsv.Staged(spark, place) as staged:
        tsv.write_text(spark, f"{staged}/a.txt", "x")
    assert (tmp_path / "result" / "a.txt").read_text() == "x"
    with pytest.raises(FileExistsError):
        tsv.Staged(spark, place)
    with pytest.raises(ValueError):
        tsv.Staged(spark, str(tmp_path / "in" / "out"), (str(tmp_path / "in"),))


def test_profile(spark, tmp_path):
    rows = tsv.read_tsv(spark, put(tmp_path, GOOD), SOURCE_COLUMNS)
    got = profile.profile_source(rows, "S1-").first()
    assert (got.records, got.blank_names, got.blank_addresses, got.non_ascii_names, got.unexpected_id_prefix) == (3, 1, 1, 1, 0)
    assert [tuple(r) for r in profile.literal_tokens(rows).collect()] == [("name", "NA", 1)]
    truth = spark.createDataFrame([("a", "x,y"), ("b", "z"), ("c", ""), ("d", " ")], ", ".join(f"{c} string" for c in TRUTH_COLUMNS))
    got = profile.truth_summary(truth).first()
    assert tuple(got) == (4, 2, 3, 0.75, 2)
    assert tuple(profile.truth_summary(truth.limit(0)).first()) == (0, 0, 0, 0.0, 0)


def test_score_files(spark, tmp_path):
    lists = lambda column, rows: f"source1_entity_id\t{column}\n" + "".join(f"{a}\t{b}\n" for a, b in rows)
    true = put(tmp_path, lists("matched_entity_ids", [("S1-a", "S2-1,S2-2,S3-1,S3-2"), ("S1-b", "S2-3"), ("S1-c", "")]), "t.tsv")
    chosen = put(tmp_path, lists("matched_entity_ids", [("S1-a", "S2-1,S2-2,S3-1,S3-2"), ("S1-b", ""), ("S1-c", "")]), "p.tsv")
    cands = put(tmp_path, lists("candidate_entity_ids", [("S1-a", "S2-1,S2-2,S3-1,S3-2"), ("S1-b", ""), ("S1-c", "")]), "c.tsv")
    source = put(tmp_path, HEADER + "S1-a\t\t\tX\nS1-b\t\t\tY\nS1-c\t\t\tX\n", "s.tsv")
    got = workflows.score_files(spark, true, chosen, cands, None, source)
    assert got["macro_f05"] == pytest.approx(2 / 3)
    assert (got["tp"], got["fp"], got["fn"], got["precision"], got["recall"]) == (4, 0, 1, 1.0, 0.8)
    assert got["candidate_diagnostics"]["pair_recall"] == 0.8 and set(got["by_country"]) == {"X", "Y"}
    short = put(tmp_path, lists("matched_entity_ids", [("S1-a", "")]), "short.tsv")
    with pytest.raises(DataFormatError, match="coverage"):
        workflows.score_files(spark, true, short)
    other = put(tmp_path, lists("matched_entity_ids", [("S1-a", "S2-9"), ("S1-b", ""), ("S1-c", "")]), "o.tsv")
    with pytest.raises(DataFormatError, match="candidates"):
        workflows.score_files(spark, true, other, cands)


@pytest.mark.parametrize("text", ["S2-1,", "S2-1, S2-2", "S1-1", "S2-1,S2-1", "S2-"])
def test_invalid_lists(spark, tmp_path, text):
    path = put(tmp_path, f"source1_entity_id\tmatched_entity_ids\nS1-a\t{text}\n")
    with pytest.raises(DataFormatError):
        workflows.load_lists(spark, path, "matched_entity_ids")
