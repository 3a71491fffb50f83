import random
import re

from pyspark.sql import functions as F

from tests.llm.conftest import ODD
from twintally.llm import lines

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words_of(line):
    return tuple(WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in line)))


def within_one(x, y):
    if len(x) > len(y):
        x, y = y, x
    if len(x) == len(y):
        return sum(a != b for a, b in zip(x, y)) <= 1
    return len(y) - len(x) == 1 and any(y[:k] + y[k + 1 :] == x for k in range(len(y)))


def units_of(own):
    """What a line is compared by: its words, its characters, or nothing but the whole."""
    text = " ".join(own)
    return ("word", own) if len(own) >= lines.NEAR_WORDS else ("character", tuple(text)) if len(text) >= lines.NEAR_CHARACTERS else (None, own)


def brute(rows):
    """Rows with shortened texts, by comparing every line with every earlier one."""
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, k))
    seen, out = {}, {}
    for k in order:
        kept, text = [], rows[k][1]
        for line in (text or "").split("\n"):
            own = words_of(line)
            if own:
                kind, units = units_of(own)
                gone = own in seen or any(kind and kind == other and within_one(units, x) for other, x in seen.values())
                seen.setdefault(own, (kind, units))
                if gone:
                    continue
            kept.append(line)
        out[k] = None if text is None else "\n".join(kept)
    return [(rows[k][0], out[k]) for k in range(len(rows))]


def test_texts_are_those_of_brute_force(docs):
    rng = random.Random(2)
    vocabulary = ["a", "Ba", "c", "dé", "e."]
    some = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    pool = [some(rng.randrange(3, 16)) for _ in range(40)]
    rows = []
    for k in range(80):
        text = []
        for _ in range(rng.randrange(5)):
            own = list(rng.choice(pool))
            for _ in range(rng.randrange(3)):
                at = rng.randrange(len(own))
                own[at : at + rng.randrange(2)] = some(rng.randrange(2))
                own = own or ["a"]
            text.append(rng.choice([" ", "  ", "\t"]).join(own))
        rows.append((k // 2 if k > 70 else k, rng.choice(["\n", "\n\n"]).join(text)))
    han = "".join(chr(0x4E00 + rng.randrange(3)) for _ in range(45))
    for k in range(30):
        at = rng.randrange(45)
        rows.append((200 + k, han[:at] + rng.choice(["", "語", han[at : at + 2]]) + han[at + 1 :] + rng.choice(["\n", "\nab\n", "\n \nA b"])))
    rows += ODD
    # One partition, so that rows with equal ids have a known order.
    out = lines.dedup_lines(docs(rows, n_lines="old", row=1, first=2, gone=3, keys="x").coalesce(1)).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in out), key=str) == sorted(brute(rows), key=str)
    assert any(r["n_dropped"] for r in out) and all(r["n_dropped"] <= r["n_lines"] and r["row"] == 1 for r in out)


def test_near_neighbours_go_and_chains_stay_whole(docs):
    base = [f"w{k}" for k in range(12)]
    near, far = ["x"] + base[1:], ["x", "y"] + base[2:]
    rows = [(3, " ".join(near)), (2, " ".join(base)), (4, " ".join(far)), (5, " ".join(base[:6] + ["more"] + base[6:])), (6, " ".join(base[:-1]))]
    out = {r["doc_id"]: r["text"] for r in lines.dedup_lines(docs(rows)).collect()}
    # 4 is within one edit of 3, which was there before; that 3 goes itself doesn't matter.
    assert out == {2: " ".join(base), 3: "", 4: "", 5: "", 6: ""}


def test_one_edit(spark):
    rng = random.Random(4)
    some = lambda: [rng.choice("ab") for _ in range(rng.randrange(1, 6))]
    pairs = [(some(), some()) for _ in range(400)]
    found = spark.createDataFrame(pairs, "x array<string>, y array<string>").select("x", "y", lines.one_edit(F.col("x"), F.col("y")).alias("near")).collect()
    assert all(r["near"] == within_one(tuple(r["x"]), tuple(r["y"])) for r in found)


def test_empty_table(docs):
    assert lines.dedup_lines(docs([])).collect() == []


def test_lines_of_few_words_and_without_spaces(docs):
    han = "".join(chr(0x4E00 + k) for k in range(40))
    rows = [(1, f"{han}\nchapter 1\nan ordinary line of some forty characters"), (2, han[:9] + "x" + han[9:]), (3, "chapter 2\nChapter  1"), (4, "an ordinary line of some fourty characters"), (5, "日本")]
    rows += [(6, "日本"), (7, "a line of other words that is just as long")]
    out = {r["doc_id"]: (r["text"], r["n_lines"], r["n_dropped"]) for r in lines.dedup_lines(docs(rows)).collect()}
    assert out == {1: (rows[0][1], 3, 0), 2: ("", 1, 1), 3: ("chapter 2", 2, 1), 4: ("", 1, 1), 5: ("日本", 1, 0), 6: ("", 1, 1), 7: (rows[6][1], 1, 0)}


def test_a_text_of_very_many_lines(docs):
    from time import perf_counter

    rows = [(1, "\n".join(["the very same line again"] * 100_000))]
    lines.dedup_lines(docs([(1, "a")])).collect()
    began = perf_counter()
    (row,) = lines.dedup_lines(docs(rows)).collect()
    assert row["text"] == "the very same line again" and row["n_dropped"] == 99_999
    assert perf_counter() - began < 30


def test_rows_keep_their_lines_when_the_input_is_split_anew(spark, tmp_path, monkeypatch):
    """As after a lost executor: the files are read in other splits by each job."""
    from tests.llm.conftest import splits_anew

    rows = [(k, f"line number {k % 700} of this text\nits own line {k}") for k in range(2000)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(str(tmp_path / "t"))
    with splits_anew(spark, lines, monkeypatch):
        out = lines.dedup_lines(spark.read.parquet(str(tmp_path / "t")), of_files=True).collect()
    assert {r["doc_id"]: r["text"] for r in out} == {k: t if k < 700 else t.split("\n")[1] for k, t in rows}
