import pytest

from twintally import run, run_families
from twintally.plans import batch


@pytest.fixture
def deliveries(write, tmp_path):
    write("old/DW.D.PLZAA.SAME.csv", "K_1;V\n1;a\n2;b\n")
    write("new/SAME.csv", "K_1|V\n1|a\n2|b\n")
    write("old/VALUES.csv", "K_1;V;W\n1;10,5;\n2;x;\n3;only old;\n")
    write("new/VALUES.csv", "K_1;V;W;N_1\n1;10;filled;q\n2;x;;q;extra\n2; x;;q\n4;only new;;q\n")
    write("old/NO_KEY.csv", "V_1;W\na;a\na;a\na;a\na;a\na;a\nb;a\n")
    write("new/NO_KEY.csv", "V_1;W\na;a\na;z\na;a\na;a\na;a\nb;a\nb;a\n")
    write("old/ALONE.csv", "K_1;V\n1;a\n")
    write("old/BROKEN.csv", "K_1;V\n1;a\n")
    write("new/BROKEN.csv", "K_1;V\n1;a\n")
    return str(tmp_path / "old"), str(tmp_path / "new"), str(tmp_path / "out")


def test_run(spark, deliveries, monkeypatch):
    read = batch.read_deliveries

    def failing(spark, paths, **options):
        if any("new/BROKEN" in path for path in paths):
            raise OSError("unreadable")
        return read(spark, paths, **options)

    monkeypatch.setattr(batch, "read_deliveries", failing)
    monkeypatch.setattr(batch, "read_delimited", lambda spark, path, **options: failing(spark, [path], **options)[0])
    seen = []
    old, new, out = deliveries
    records = run(spark, old, new, out, on_progress=lambda label, done, total: seen.append((label, total)))
    rows = {r["label"]: r for r in records.collect()}
    assert set(rows) == {"SAME", "VALUES", "NO_KEY", "BROKEN"} and len(seen) == 4
    same, values, no_key, broken = (rows[label] for label in ("SAME", "VALUES", "NO_KEY", "BROKEN"))
    assert (same["sep_ok"], same["n_diff_rows"], same["n_only_a"], same["n_only_b"]) == (False, 0, 0, 0)
    assert (values["rows_a"], values["rows_b"], values["n_rejected_b"], values["n_spaced_b"]) == (3, 3, 1, 1)
    assert values["cols_only_b"] == ["N_1"] and (values["n_diff_rows"], values["n_only_a"], values["n_only_b"]) == (1, 1, 1)
    # W is empty in the old file and filled in the new one: a value difference, not a missing column.
    assert [m["column"] for m in values["type_mismatches"]] == ["W"]
    assert (no_key["n_diff_rows"], no_key["n_only_b"]) == (1, 1)
    assert broken["error"] == "unreadable"

    def written(name):
        return spark.read.parquet(f"{out}/{name}")

    outcome = {r["label"]: r["outcome"] for r in written("issue_summary").collect()}
    assert outcome == {"SAME": "ANOMALIE", "VALUES": "ANOMALIE", "NO_KEY": "ANOMALIE", "BROKEN": "ERRORE: unreadable"}
    assert tuple(written("issue_totals").first()) == (4, 3)
    assert [tuple(r) for r in written("unpaired").collect()] == [("ALONE", "ALONE.csv", None)]
    assert [(r["side"], r["line_no"]) for r in written("issue_lines").collect()] == [("TO-BE", 3)]
    assert {r["label"]: r["outcome"] for r in written("pair_summary").collect()}["SAME"] == "OK"
    cells = written("diff_cells/label=VALUES").collect()
    assert sorted((r["K_1"], r["column"], r["num_diff"]) for r in cells) == [("1", "V", 0.5), ("1", "W", None)]


def test_run_with_filter_key_and_csv(spark, deliveries, tmp_path):
    old, new, out = deliveries
    records = run(spark, old + "/VALUES.csv", new + "/VALUES.csv", out, key=["K_1"], row_filter={"k_1": "2"}, format="csv")
    row = records.first()
    assert (row["rows_a"], row["rows_b"], row["n_diff_rows"]) == (1, 1, 0)
    summary = spark.read.option("header", True).csv(out + "/pair_summary/label=VALUES").first()
    assert summary["row_filter"] == "k_1 = '2'" and summary["key_used"] == "K_1"


def test_run_families(spark, write, tmp_path):
    write("base/DW.M.PLZ3A.ALL.20260326000000.20260326000000/A.T1.20260326000000.csv", "K;V\n1;a\n2;b\n")
    write("base/DW.M.PLZ3A.ALL.20260326000000.20260326000000/A.T2.csv", "K;V\n1;a\n")
    write("base/DW.M.PLZ3A.ALL/A.T1.csv", "K;V\n1;a\n2;c\n3;d\n")
    write("base/DW.M.PLZ3A.ALL/A.T3.csv", "")
    rows = run_families(spark, str(tmp_path / "out"), base_dir=str(tmp_path / "base")).orderBy("logical_name").collect()
    found = [(r["logical_name"], r["name_a"], r["name_b"], r["rows_a"], r["rows_b"], r["rows_with_diff"], r["outcome"]) for r in rows]
    assert found == [
        ("A.T1", "A.T1.20260326000000.csv", "A.T1.csv", 2, 3, 1, "DIFFERENZE"),
        ("A.T2", "A.T2.csv", "— MANCANTE —", 1, 0, 0, "DIFFERENZE"),
        ("A.T3", "— MANCANTE —", "A.T3.csv", 0, 0, 0, "OK"),
    ]


def test_labels_of_any_characters_and_a_second_run(spark, tmp_path):
    from twintally import write_reports

    out = str(tmp_path / "reports")
    table = lambda n: spark.createDataFrame([(k,) for k in range(n)], "v int")
    labels = ["A%20B=1", "a b/c", "ü:*?", "{x}"]
    for n, label in enumerate(labels, 1):
        write_reports({"r": table(n)}, out, label)
    write_reports({"r": table(7)}, out, labels[1])
    found = {r["label"]: r["count"] for r in spark.read.parquet(f"{out}/r").groupBy("label").count().collect()}
    assert found == {labels[0]: 1, labels[1]: 7, labels[2]: 3, labels[3]: 4}


def test_reports_without_rows_leave_no_partition_behind(spark, tmp_path):
    from twintally import write_reports

    out, rows = str(tmp_path / "reports"), spark.createDataFrame([(1,)], "v int")
    write_reports({"r": rows}, out, "x")
    write_reports({"r": rows.limit(0)}, out, "x")
    assert spark.read.parquet(f"{out}/r").where("label = 'x'").count() == 0
