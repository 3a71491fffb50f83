import random
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import ODD
from twintally.llm import languages
from twintally.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.01"
ENGLISH = "the house is near the river and they think that this was what she had with her when the others came"
FRENCH = "la maison est dans la rue et nous pensons que c'est ce qu'elle avait avec les autres quand ils sont venus"
RUSSIAN = "дом стоит у реки и они думают что это было то что она имела когда пришли другие"


def words(text):
    out, start = [], None
    for k, c in enumerate(text + " "):
        inside = unicodedata.category(c)[0] in "LM"
        if inside and start is None:
            start = k
        if not inside and start is not None:
            out.append((start, k))
            start = None
    return out


@pytest.fixture(scope="module")
def model(spark):
    rows = [("en", ENGLISH)] * 3 + [("fr", FRENCH)] * 3 + [("ru", RUSSIAN)] * 3 + [(None, "zzz zzz"), ("en", None)]
    return languages.learn(spark.createDataFrame(rows, "lang string, text string"))


def plain_path(scores, penalty):
    """Viterbi word by word."""
    n = scores.shape[1]
    now, back = np.zeros(n), []
    for s in scores.astype(np.float64):
        top = int(now.argmax())
        back.append([j if now[j] >= now[top] - penalty else top for j in range(n)])
        now = s + np.maximum(now, now[top] - penalty)
    label, out = int(now.argmax()), []
    for step in reversed(back):
        out.append(label)
        label = step[label]
    return out[::-1]


def test_paths_are_those_of_viterbi_word_by_word():
    rng = np.random.default_rng(1)
    for n in (1, 2, 5):
        lengths = [0, 1, 3, 64, 65, 128, 500, 0, 7]
        scores = rng.integers(-40, 0, (sum(lengths), n)).astype(np.float32) / 4
        begin = np.append(0, np.cumsum(lengths))
        for block in (1, 4, 64):
            found = languages.best_path(scores, begin, 8.0, block)
            for a, b in zip(begin[:-1], begin[1:]):
                assert found[a:b].tolist() == plain_path(scores[a:b], 8.0)


def test_words_and_trigrams(docs):
    text = "Né a.b ça-va Привет日本 ́x 12"
    import pyarrow as pa

    from twintally.llm.words import slices

    (_, _, data, offsets), = slices(pa.array([text, None, "", "Cd"]))
    found = languages.words_of(data, offsets)
    spelled = [(text + "Cd")[a:b] for a, b in zip(found.first, found.end)]
    assert spelled == ["Né", "a", "b", "ça", "va", "Привет", "日本", "x", "Cd"]
    assert found.text.tolist() == [0] * 8 + [3]
    again = languages.words_of(*[x for x in slices(pa.array(["né ça cD"]))][0][2:])
    assert again.trigrams[:2].tolist() == found.trigrams[:2].tolist() and again.trigrams[-2:].tolist() == found.trigrams[-2:].tolist()


def test_scripts_narrow_the_candidates(model):
    at = [name for name, _ in languages.SCRIPTS]
    assert model.names == ["en", "fr", "ru"]
    assert model.allowed[:, at.index("Cyrillic")].tolist() == [False, False, True]
    assert model.allowed[:, at.index("Latin")].tolist() == [True, True, False]
    assert model.allowed[:, at.index("Thai")].all()


def test_spans_of_mixed_texts(docs, model):
    text = f"{ENGLISH}. {FRENCH}! {RUSSIAN}"
    rows = [(101, text), (102, FRENCH.upper()), (103, "12 + 4"), (104, None), (105, "日本語"), *ODD]
    out = languages.predict(docs(rows, lang="xx", score=1, spans=2), model).collect()
    found = {r["doc_id"]: r for r in out if r["doc_id"]}
    spans = [(s["lang"], text[s["start"] : s["end"]]) for s in found[101]["spans"]]
    assert [x for x, _ in spans] == ["en", "fr", "ru"]
    assert spans[0][1].startswith("the house") and spans[2][1] == RUSSIAN and 0.3 < found[101]["score"] < 0.5
    assert found[102]["lang_pred"] == "fr" and found[102]["score"] == 1
    assert len(out) == len(rows) and all(r["lang_pred"] in ("en", "fr", "ru", "und") and 0 <= r["score"] <= 1 for r in out)
    assert found[103]["lang_pred"] == found[104]["lang_pred"] == found[2]["lang_pred"] == "und" and found[105]["lang_pred"] != "und"
    assert all((r["lang_pred"] == "und") == (not r["spans"]) == (r["score"] == 0) for r in out)


def test_nothing_learned_and_empty_tables(spark, docs):
    none = languages.learn(spark.createDataFrame([], "lang string, text string"))
    assert {(r["lang_pred"], r["score"]) for r in languages.predict(docs([(1, ENGLISH), (2, None)]), none).collect()} == {("und", 0.0)}
    assert languages.predict(docs([]), none).collect() == []


def test_a_long_text_of_many_languages(docs, model):
    rng = random.Random(3)
    order = [rng.choice("efr") for _ in range(300)]
    order = [x for k, x in enumerate(order) if not k or order[k - 1] != x]
    text = " ".join({"e": ENGLISH, "f": FRENCH, "r": RUSSIAN}[x] for x in order)
    (row,) = languages.predict(docs([(1, text)]), model).collect()
    assert [s["lang"][0] for s in row["spans"]] == order


def test_held_out_accuracy_of_the_query(spark):
    out = QUERIES["op13_language_spans"](spark, SMALL)
    assert [t for _, t in out.dtypes[:4]] == ["bigint", "boolean", "string", "double"]
    truth = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "lang")
    held = out.join(truth, "doc_id").where("held_out").select(F.avg((F.col("lang_pred") == F.col("lang")).cast("int")), F.count("*")).first()
    assert held[1] > 200 and held[0] > 0.98
    assert out.where("held_out <> (pmod(crc32(cast(cast(doc_id as string) as binary)), 4) = 2)").count() == 0
