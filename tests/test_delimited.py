import random
import re
import zipfile
from contextlib import contextmanager

import pytest

from twintally import find_families, list_deliveries, list_sources, match_files, read_deliveries, read_delimited
from twintally.operators.pairing import match_logical


def clean_text(value):
    return re.sub("[ \t]+", " ", value.strip()).strip()


@contextmanager
def many_splits(spark, size):
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        yield
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def content(delivery):
    rows = [tuple(r) for r in delivery.ordered.orderBy("_file", "_block", "_at").select(*[f"`{c}`" for c in delivery.columns]).collect()]
    return delivery.columns, rows, [tuple(r) for r in delivery.rejected.orderBy("line_no").collect()]


@pytest.mark.parametrize(
    "raw, options, columns, rows, rejected",
    [
        ("A;B\n1;2\n4;5;6\n7;8\n9\n", {}, ["A", "B"], [("1", "2"), ("7", "8"), ("9", "")], [(3, "4;5;6")]),
        ("A;B\n1;2;\n3;4;\n", {}, ["A", "B"], [("1", "2"), ("3", "4")], []),
        ("£A;£B;£C\n£1;£x;£€\n".encode("cp1252"), {"sep": ";£"}, ["A", "B", "C"], [("1", "x", "€")], []),
        ("£A;£B;£C\n£1;£x;£y\n", {"sep": ";"}, ["A", "B", "C"], [("1", "x", "y")], []),
        ("A;#B;#C;#\n1;#2;#3;#\n", {}, ["A", "B", "C"], [("1", "2", "3")], []),
        ("A;A;;B\n1;2;3;4\n", {}, ["A", "A_1", "B"], [("1", "2", "4")], []),
        ("1;2024-01-31;x y\n", {}, ["Col_1", "Col_2", "Col_3"], [("1", "2024-01-31", "x y")], []),
        ('K_1;V\n1;"x;y"\n2; a\t b  c\n', {}, ["K_1", "V"], [("1", "x;y"), ("2", "a b c")], []),
        ('K_1;V\n1;"x"\n', {"quote": None}, ["K_1", "V"], [("1", '"x"')], []),
        ("\n\nA;B\n\n1;2\n \n3;4\nA;B\n", {}, ["A", "B"], [("1", "2"), ("3", "4"), ("A", "B")], []),
        ("﻿A_1;B\n1;2\n", {}, ["A_1", "B"], [("1", "2")], []),
        ("", {}, [], [], []),
        ("A;B\n", {}, ["A", "B"], [], []),
        ("A;B\r\n1;è\r\n", {}, ["A", "B"], [("1", "è")], []),
        ("a b;c;\n1; 2  x ;\n", {"legacy": True}, ["a b", "c"], [("1", "2  x")], []),
        ("1;2\n", {"legacy": True}, ["0", "1"], [("1", "2")], []),
        ('K_1;V\n1;"x\ny"\n2;"say ""hi"""\n3;z;long\n4\n', {}, ["K_1", "V"],
         [("1", "x\ny"), ("2", 'say "hi"'), ("4", "")], [(5, "3;z;long")]),
        ('K_1;V\n1;"è\n€"\n'.encode("cp1252"), {}, ["K_1", "V"], [("1", "è\n€")], []),
        ('K_1;V\n1;"x\ny"\n', {"multi_line": False}, ["K_1", "V"], [("1", '"x'), ('y"', "")], []),
        ('"K_1";"a\nb"\n1;2\n', {}, ["K_1", "a\nb"], [("1", "2")], []),
        ('K_1;V\n1;"x;\n""y"";\n\nz";\n2;5" pipe\n"3 "" ";"a"\n', {}, ["K_1", "V"], [("1", 'x;\n"y";\n\nz'), ("2", '5" pipe'), ('3 "', "a")], []),
        ('K_1;V\n1;"never\n2;closed\n3;x\n', {}, ["K_1", "V"], [("1", '"never'), ("2", "closed"), ("3", "x")], []),
    ],
)
def test_read(spark, write, raw, options, columns, rows, rejected):
    assert content(read_delimited(spark, write("f.csv", raw), **options)) == (columns, rows, rejected)


def test_line_numbers_and_order_over_many_splits(spark, write):
    lines = ["K_1;V"] + [f"{i};{'x' * (i % 50)}" + (";too;long" if i % 97 == 0 else "") for i in range(1, 3001)]
    path = write("big.csv", "\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    try:
        delivery = read_delimited(spark, path)
        assert delivery.ordered.select("_block").distinct().count() > 5
        rejected = [(r["line_no"], r["line"]) for r in delivery.rejected.orderBy("line_no").collect()]
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert rejected == [(i + 1, line) for i, line in enumerate(lines) if line.endswith(";too;long")]
    keys = [int(r["K_1"]) for r in delivery.ordered.orderBy("_file", "_block", "_at").collect()]
    assert keys == [i for i in range(1, 3001) if i % 97]


def test_archives(spark, tmp_path, write):
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as archive:
        archive.writestr("in/one.csv", "A_1;B\n1;2\n")
        archive.writestr("two.CSV", "A_1|B\r\n1|\xe8\r\n3|4|5\r\n".encode("cp1252"))
        archive.writestr("__MACOSX/x.csv", "zz")
        archive.writestr("notes.txt", "zz")
    write("bad.zip", "nope")
    write("empty.csv", "")
    write("sub/deep.csv", "A;B\n")
    found = {r["name"]: (r["path"], r["size"]) for r in list_sources(spark, str(tmp_path)).collect()}
    assert set(found) == {"one.csv", "two.CSV", "empty.csv"} and found["one.csv"][1] == 10 and found["empty.csv"][1] == 0
    assert content(read_delimited(spark, found["one.csv"][0])) == (["A_1", "B"], [("1", "2")], [])
    two = read_delimited(spark, found["two.CSV"][0])
    assert (two.sep, two.encoding) == ("|", "cp1252")
    assert content(two) == (["A_1", "B"], [("1", "è")], [(3, "3|4|5")])
    assert list_sources(spark, str(tmp_path / "z.zip")).count() == 2


def test_pairing(spark):
    schema = "name string, path string"
    a = spark.createDataFrame([("DW.D.PLZAA.T1.csv", "a1"), ("T2.csv", "a2"), ("D.PLZBB.T1.csv", "a3")], schema)
    b = spark.createDataFrame([("T1.20260326000000.csv", "b1"), ("T1.csv", "b2"), ("T9.csv", "b9")], schema)
    left = sorted((r["label"], r["path_a"], r["path_b"] or "") for r in match_files(a, b).collect())
    assert left == [("T1", "a1", "b2"), ("T1", "a3", "b2"), ("T2", "a2", "")]
    full = {(r["label"], r["path_a"], r["path_b"]) for r in match_files(a, b, "full").collect()}
    assert full == {("T1", "a1", "b2"), ("T1", "a3", "b2"), ("T2", "a2", None), ("T9", None, "b9")}
    logical = {r["logical_name"]: (r["short_name"], r["path_a"], r["path_b"]) for r in match_logical(a, b).collect()}
    assert logical["T1"] == ("T1", None, "b2") and logical["DW.D.PLZAA.T1"] == ("T1", "a1", None)


def test_families(spark, write, tmp_path):
    for folder in ("DW.M.PLZ3A.ALL.20260326000000.20260326000000", "DW.M.PLZ3A.ALL", "OTHER"):
        write(f"{folder}/x.csv", "A;B\n1;2\n")
    write("DW.M.PLZ3A.ALL.zip", "x")
    write("DW.M.PLZHA.ALL.20260101000000.20260101000000.zip", "x")
    write("DW.M.PLZHA.ALL.20260201000000.20260201000000.zip", "x")
    found = {r["family"]: (r["asis"], r["tobe"]) for r in find_families(list_deliveries(spark, str(tmp_path))).collect()}
    assert found == {
        "DW.M.PLZ3A.ALL": ("DW.M.PLZ3A.ALL.20260326000000.20260326000000", "DW.M.PLZ3A.ALL.zip"),
        "DW.M.PLZHA.ALL": ("DW.M.PLZHA.ALL.20260201000000.20260201000000.zip", None),
    }
    assert find_families(list_deliveries(spark, str(tmp_path)), "plzha").count() == 1


def test_all_lines_decide_on_prefixes(spark, write):
    plain, marked = [f"{i};v" for i in range(2970)], [f"#{i};#v" for i in range(30)]
    first = read_delimited(spark, write("m.csv", "\n".join(["A_1;B", *marked, *plain])))
    last = read_delimited(spark, write("p.csv", "\n".join(["A_1;B", *plain[:30], *marked, *marked, *marked])))
    assert "#" not in first.strip_chars and first.rows.where("B = '#v'").count() == 30
    assert "#" in last.strip_chars and last.rows.where("B = '#v'").count() == 0


def test_all_lines_decide_on_the_separator(spark, write):
    found = read_delimited(spark, write("s.csv", "\n".join(["A_1|B"] + ["x,y,z|1"] * 40 + ["p|2"] * 4000)))
    assert found.sep == "|" and found.columns == ["A_1", "B"] and found.rejected.count() == 0


def test_parts_with_headers_and_a_mark(spark, write, tmp_path):
    write("d/part-0.csv", "﻿A_1;B\n1;x\n")
    write("d/part-1.csv", "A_1;B\n﻿2;y\nA_1;B\n3;z\n3;z\n3;z\n")
    found = read_delimited(spark, str(tmp_path / "d"))
    assert found.columns == ["A_1", "B"]
    assert sorted(tuple(r) for r in found.rows.collect()) == sorted([("1", "x"), ("﻿2", "y"), ("A_1", "B")] + [("3", "z")] * 3)


def test_rejected_lines_are_whole(spark, write):
    long = "a;b;" + "c" * 5000
    found = read_delimited(spark, write("l.csv", f"A_1;B\n1;2\n{long}\n"))
    assert [r["line"] for r in found.rejected.collect()] == [long]


def test_quoted_line_breaks_over_many_splits(spark, write):
    rng = random.Random(1)
    rows = []
    for k in range(800):
        text = "".join(rng.choice(["a", ";", '""', "\n", "\n\n", " b", "5"]) for _ in range(rng.randrange(12)))
        rows.append((str(k), text))
    raw = "K_1;V\n" + "".join(f'{k};"{t}"\n' if rng.random() < 0.9 or set(t) & set('\n";') else f"{k};{t}\n" for k, t in rows)
    path = write("q.csv", raw)
    # Characters of the separator go from the left of values.
    expected = [(k, clean_text(t.replace('""', '"').lstrip(" ").lstrip(";"))) for k, t in rows]
    with many_splits(spark, "1500"):
        found = read_delimited(spark, path)
        assert found.ordered.select("_block").distinct().count() > 5 and found.rejected.count() == 0
        assert content(found)[1] == expected
        assert found.n_rows == 800 and found.n_rejected == 0


def test_a_record_over_several_blocks_and_a_quote_that_stays_open(spark, write):
    long = "\n".join(f"line {k} of a value" for k in range(200))
    raw = f'K_1;V\n1;"{long}"\n2;x\n3;y;z\n4;"open\n5;b\n' + "6;c\n" * 50
    with many_splits(spark, "256"):
        found = read_delimited(spark, write("o.csv", raw))
        columns, rows, rejected = content(found)
    assert rows[:4] == [("1", long), ("2", "x"), ("4", '"open'), ("5", "b")] and rows[4:] == [("6", "c")] * 50
    assert rejected == [(203, "3;y;z")]


def test_quoted_line_breaks_inside_an_archive(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as archive:
        archive.writestr("q.csv", 'K_1;V\n1;"two\nlines"\n2;x;y\n')
    found = read_delimited(spark, str(tmp_path / "z.zip") + "::q.csv")
    assert content(found) == (["K_1", "V"], [("1", "two\nlines")], [(4, "2;x;y")])


@pytest.mark.parametrize(
    "line, outside, inside",
    [("a;b", False, True), ('a;"b', True, False), ('"a";"b"', False, False), ('a";b', False, False), ('x";"y', True, True), ('"', True, False), ('""', False, True),
     ('5" a;"b', True, True), ('"a;"', False, True), ('a; "b""', True, False), ('"a"b;"c', True, True), ("", False, True), ('a;"b"";c', True, False)],
)
def test_states_of_a_line(spark, line, outside, inside):
    from pyspark.sql import functions as F

    from twintally.operators.quoted import opens, stays_inside

    df = spark.createDataFrame([(line, ";")], "v string, s string")
    found = df.select(opens(F.col("v"), F.col("s")), stays_inside(F.col("v"), F.col("s")), opens(F.col("v"), ";")).first()
    assert tuple(found) == (outside, inside, outside) == (*automaton(line), outside)


def automaton(line):
    """The states behind a line, character by character, for both states before it."""
    out = []
    for state in ("start", "in"):
        for c in line:
            if state == "in":
                state = "maybe" if c == '"' else "in"
            elif state == "maybe":
                state = "in" if c == '"' else "start" if c == ";" else "plain"
            elif c == ";":
                state = "start"
            elif state == "start" and c == '"':
                state = "in"
            elif not (state == "start" and c == " "):
                state = "plain"
        out.append(state == "in")
    return tuple(out)


def test_conditions_on_entries_choose_partitions(spark, tmp_path):
    from twintally.sources.archive import register

    register(spark)
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as archive:
        for k in range(6):
            archive.writestr(f"in/e{k}.csv", f"{k}\n\n")
        archive.writestr("empty.txt", "")
    lines = spark.read.format("zip_lines").load(str(tmp_path / "z.zip"))
    assert lines.rdd.getNumPartitions() == 7 and lines.count() == 12
    some = lines.where("entry in ('in/e1.csv', 'in/e4.csv')")
    assert some.rdd.getNumPartitions() == 2 and sorted((r["entry"], r["at"], bytes(r["value"])) for r in some.collect()) == [("in/e1.csv", 0, b"1"), ("in/e1.csv", 1, b""), ("in/e4.csv", 0, b"4"), ("in/e4.csv", 1, b"")]
    assert lines.where("entry LIKE 'in/%'").rdd.getNumPartitions() == 6
    entries = spark.read.format("zip_entries").load(str(tmp_path / "z.zip"))
    assert entries.where("entry LIKE '%.txt'").collect()[0]["size"] == 0


def test_many_files_take_as_many_jobs_as_one(spark, write):
    paths = [write(f"many/f{k}.csv", f"A_{k}{s}B\n" + "".join(f"{j}{s}é{k}\n" for j in range(k)) + (f"x{s}y{s}z\n" if k % 3 == 0 else "")) for k, s in ((k, ";|,\t"[k % 4]) for k in range(50))]
    paths[7] = write("many/f7.csv", "A_7\tB\n1\t£\n".encode("cp1252"))
    paths[8] = write("many/f8.csv", "")

    def jobs(own):
        group = f"jobs-{len(own)}"
        spark.sparkContext.setJobGroup(group, group)
        try:
            return read_deliveries(spark, own), len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)

    _, few = jobs(paths[1:3])
    found, many = jobs(paths)
    assert many <= few + 4  # adaptive plans may add one here and there
    for k, d in enumerate(found):
        if k not in (7, 8):
            assert (d.sep, d.columns, d.n_rows, d.n_rejected) == (";|,\t"[k % 4], [f"A_{k}", "B"], k, int(k % 3 == 0 and k > 0) if k else 0) or k < 4
    assert found[7].encoding == "cp1252" and found[7].rows.collect()[0]["B"] == "£" and found[8].columns == [] and found[8].n_rows == 0
    assert sorted(tuple(r) for r in found[21].rows.collect()) == sorted((str(j), "é21") for j in range(21))


def test_a_row_filter_is_applied_before_rows_are_written(spark, write):
    path = write("f.csv", "K_1;V\n" + "".join(f"{k}; {'keep' if k % 10 == 0 else 'drop'}\n" for k in range(100)) + "1;keep;z\n")
    found = read_deliveries(spark, [path], row_filter={"v": "keep ", "absent": "x"})[0]
    assert found.n_rows == 10 and found.n_rejected == 1 and found.unfiltered == ("absent",) and found.n_spaced == 100
    assert {r["K_1"] for r in found.rows.collect()} == {str(k) for k in range(0, 100, 10)}
    written = spark.read.parquet(found.ordered.inputFiles()[0].rsplit("/delivery=", 1)[0])
    assert written.where("_c0 IS NOT NULL").count() == 10
