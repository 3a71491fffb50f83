import random
import re

from twintally.llm.rules import Limits, keep_good, measure

from tests.llm.conftest import ODD

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def covered_by(words, least):
    """Words in windows of ``least`` words that occur twice or more."""
    where = {}
    for i in range(len(words) - least + 1):
        where.setdefault(tuple(words[i : i + least]), []).append(i)
    return len({j for at in where.values() if len(at) > 1 for i in at for j in range(i, i + least)})


def longest_repeat(words):
    return max((n for n in range(1, len(words)) if len({tuple(words[i : i + n]) for i in range(len(words) - n + 1)}) < len(words) - n + 1), default=0)


def brute(text, limits):
    text = text or ""
    words = WORD.findall(text)
    lines = [line for line in text.split("\n") if WORD.search(line)]
    again, covered, top = covered_by(words, limits.window), covered_by(words, limits.repeat_words), longest_repeat(words)
    top = top if top >= limits.repeat_words else 0
    failed = len(words) < limits.min_words or 100 * again > limits.max_window_percent * len(words)
    kept = not failed and 100 * covered <= limits.max_covered_percent * len(words) and top <= limits.max_repeat_words
    marks = sum(c in "#*$%&|<>" for c in text)
    return (len(words), sum(map(len, words)), marks, len(lines) - len(set(lines)), again, covered, top, failed, kept)


def random_text(rng):
    words = [rng.choice(["a", "bb", "ça", "d#", "e", "ff", "日本", "h*"]) for _ in range(rng.randrange(60))]
    for _ in range(rng.randrange(3)):
        if words:
            i, n, j = rng.randrange(len(words)), rng.randrange(1, 20), rng.randrange(len(words))
            words[j:j] = words[i : i + n]
    return "".join(w + rng.choice([" ", " ", "\n", "\t", "\x0b", " \n\n"]) for w in words)


def test_measures_are_those_of_brute_force(docs):
    rng = random.Random(3)
    rows = [(k, random_text(rng)) for k in range(150)] + [r for r in ODD if r[0] != 8]
    limits = Limits(max_repeat_words=12)
    found = measure(docs(rows, n_words=7, kept="x", text2="y"), limits).collect()
    assert len(found) == len(rows)
    expected = [(i, *brute(t, limits)) for i, t in rows]
    assert sorted((tuple(r) for r in found), key=str) == sorted(expected, key=str)


def test_filter_keeps_whole_rows_of_good_texts(docs):
    good = " ".join(f"w{i}" for i in range(40))
    bad = "the same eight words come here again now " * 10
    table = docs([(1, good), (2, bad), (3, None), (4, good), (4, good)], kept=1, n_words="z")
    out = keep_good(table)
    assert out.columns == table.columns
    assert sorted(r["doc_id"] for r in out.collect()) == [1, 4, 4]


def test_long_repeat_alone_rejects(docs):
    part = " ".join(f"w{i}" for i in range(60))
    text = part + " middle " + part + " " + " ".join(f"z{i}" for i in range(500))
    rows = measure(docs([(1, text)]), Limits(max_repeat_words=50)).collect()
    assert not rows[0]["base_failed"] and rows[0]["longest_repeat"] == 60 and not rows[0]["kept"]
    assert measure(docs([(1, text)]), Limits(max_repeat_words=60)).first()["kept"]


def test_empty_table(docs):
    assert measure(docs([])).collect() == [] and keep_good(docs([])).collect() == []
