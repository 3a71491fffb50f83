import random
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from tests.llm import test_copies, test_leaks, test_lines, test_rules
from tests.llm.test_packing import TOKENIZER
from twintally.llm.queries import QUERIES, SQL
from twintally.llm.rules import Limits
from twintally.sources.staging import shared_dir

SMALL = "/root/testdata/sf0.001"


def without_leaks(text, items):
    words = list(test_leaks.WORD.finditer(test_leaks.lower(text)))
    hit = test_leaks.brute(text, items)[1]
    out, at = "", 0
    for i in sorted(hit):
        if i - 1 not in hit:
            out, at = out + text[at : words[i].start()], None
        if i + 1 not in hit:
            at = words[i].end()
    return out + text[at:]


def tables(rng):
    vocabulary = [f"w{k}" for k in range(4000)]
    text = lambda n: "\n".join(" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(6, 25))) for _ in range(n))
    items = [(k, " ".join(rng.choice(vocabulary) for _ in range(15))) for k in range(4)]
    texts = [text(rng.randrange(2, 9)) for _ in range(40)]
    texts += [texts[0], texts[1].replace("w", "W", 1), texts[2] + "\nand five new words more", texts[3].replace("\n", " ")]
    texts += [text(2) + " " + items[k % 4][1] + " " + text(2) for k in range(6)]
    texts += ["too short", "", None, "again and again the same eight words " * 9, text(120)]
    order = list(range(len(texts)))
    rng.shuffle(order)
    return [(k, texts[j]) for k, j in enumerate(order)], items


def test_pipeline_is_that_of_brute_force(spark, docs, tmp_path):
    rows, items = tables(random.Random(9))
    docs(rows, lang="en", n_chars=1).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, test_leaks.ITEMS).write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    found = defaultdict(list)
    for r in sorted(out, key=lambda r: r["piece"]):
        found[r["doc_id"]] += np.frombuffer(r["ids"], "<u4").tolist()

    kept = [r for r in rows if test_rules.brute(r[1], Limits())[-1]]
    shorter = []
    for (i, before), (_, after) in zip(kept, test_lines.brute(kept)):
        if before == after or test_lines.words_of(after):
            shorter.append((i, after))
    names = defaultdict(list)
    for (i, _, name), (_, text) in zip(test_copies.brute(shorter), shorter):
        names[name].append((i, [*TOKENIZER.encode(without_leaks(text, items), add_special_tokens=False).ids, 2]))
    assert len(found) == len(names) < len(kept) < len(rows)
    for members in names.values():
        assert sum(i in found for i, _ in members) == 1
        assert all(found[i] == ids for i, ids in members if i in found)


def test_stages_return_the_columns_of_documents(spark, docs, tmp_path):
    rows, items = tables(random.Random(3))
    docs(rows, n_lines="x", row=1, node=2, spans="y").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, test_leaks.ITEMS).write.parquet(str(tmp_path / "benchmark.parquet"))
    table = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for _, function in corpus_pipeline.STAGES[:-1]:
        assert function(spark, table, str(tmp_path)).columns == table.columns


def test_documents_with_unique_short_lines_stay(spark, docs, tmp_path):
    footer = "all rights of this page are reserved"
    rows = [(1, f"an own line of some words\n{footer}"), (2, f"roses are red\nviolets are blue\n{footer}"), (3, footer), (4, f" \t\n{footer}\n"), (5, ""), (6, None), (7, "日本語\n" + footer)]
    docs(rows, n_chars=1).write.parquet(str(tmp_path / "documents.parquet"))
    table = spark.read.parquet(str(tmp_path / "documents.parquet"))
    out = {r["doc_id"]: (r["text"], r["n_chars"]) for r in corpus_pipeline.line_dedup(spark, table, str(tmp_path)).collect()}
    assert set(out) == {1, 2, 5, 6, 7}
    assert out[2] == ("roses are red\nviolets are blue", 30) and out[7] == ("日本語", 3) and out[1][0] == rows[0][1]


def test_empty_tables(spark, docs, tmp_path):
    docs([], lang="en").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], test_leaks.ITEMS).write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql_gives_the_rows_of_the_query(spark, name):
    connection = duckdb.connect()
    for table in ("documents", "benchmark", "embeddings"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SMALL}/{table}.parquet'")
    expected = connection.execute(SQL[name])
    columns = [d[0] for d in expected.description]
    df = QUERIES[name](spark, SMALL)
    assert sorted(columns) == sorted(df.columns)
    assert sorted(tuple(r[c] for c in columns) for r in df.collect()) == sorted(expected.fetchall())


def kinds_of_tables(spark):
    """Names of the staged tables that are there, with how many of each."""
    found = Path(f"{shared_dir(spark).removeprefix('file://')}/twintally/{spark.sparkContext.applicationId}").glob("*")
    return Counter(x.name.rpartition("-")[0] for x in found)


def test_stages_leave_no_tables_that_nothing_reads_any_more(spark, docs, tmp_path):
    rows, items = tables(random.Random(5))
    docs(rows, lang="en", n_chars=1).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, test_leaks.ITEMS).write.parquet(str(tmp_path / "benchmark.parquet"))
    table = spark.read.parquet(str(tmp_path / "documents.parquet"))
    before = kinds_of_tables(spark)
    assert corpus_pipeline.line_dedup(spark, table, str(tmp_path)).count()
    assert set(kinds_of_tables(spark) - before) == {"files", "lines-of-rows"}
    before = kinds_of_tables(spark)
    assert corpus_pipeline.run(spark, str(tmp_path)).count()
    left = kinds_of_tables(spark) - before
    assert left["decontamination"] == 1
    assert not left.keys() & {"quality_rules", "line_dedup", "jaccard_join", "lines-of-rows", "copies", "described"}
