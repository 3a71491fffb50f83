import random
import re

from tests.llm.conftest import ODD
from twintally.llm import disclosure


def luhn(digits):
    return sum(sum(divmod(int(c) * (1 + k % 2), 10)) for k, c in enumerate(digits[::-1])) % 10 == 0


def brute(text):
    text = text or ""
    found = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    found += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    return found + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]


def test_base_spans_are_those_of_the_patterns(docs):
    rng = random.Random(1)
    bits = ["a.b", "@", "x.org", "é", " ", "-", "+1", "(20)", "4111 1111 1111 1111", "10.0.0.1", "300.1.1.1", ".7", "0012", "555", "+", "\n", "a@b@c.d", "%"]
    rows = [(k, "".join(rng.choice(bits) for _ in range(rng.randrange(16)))) for k in range(500)] + ODD
    out = disclosure.find_personal(docs(rows, spans=1, near="x")).collect()
    found = sorted((str(r["doc_id"]), str([(s["kind"], s["start"], s["end"]) for s in r["spans"] if s["kind"] != "term"])) for r in out)
    assert found == sorted((str(i), str(brute(t))) for i, t in rows)


def test_telling_terms_are_generalised_or_removed(docs):
    rng = random.Random(2)
    fill = lambda: " ".join(rng.choice(["ordinary", "words", "stand", "everywhere", "again"]) for _ in range(12))
    rows = [(k, f"é {fill()} {k}") for k in range(200)]
    rows += [(1000 + k, f"é {fill()} {k} Zanzibar jo@firm.org wrote {k} {fill()}") for k in range(5)]
    out = {r["doc_id"]: r["text"] for r in disclosure.sanitise(docs(rows, lang="en")).collect()}
    assert all(out[k] == t for k, t in rows[:200])
    for k, t in rows[200:]:
        assert "Zanzibar" not in out[k] and "jo@firm.org" not in out[k] and "[EMAIL]" in out[k]
        assert out[k].startswith("é ") and "ordinary" in out[k] + "ordinary"
    # What all documents have gives nothing away.
    assert sum("everywhere" in out[1000 + k] for k in range(5)) == sum("everywhere" in t for _, t in rows[200:])


def test_copies_of_a_text_count_once(docs):
    text = "Zanzibar words jo@firm.org follow here"
    out = disclosure.find_personal(docs([(k, text) for k in range(6)] + [(k, f"other text {k}") for k in range(10, 60)])).collect()
    assert all(s["kind"] == "email" for r in out for s in r["spans"])


def test_copies_dont_hide_a_disclosing_term(docs):
    rows = [(100 * j + k, f"Zanzibar number{j} jo@firm.org") for j in range(3) for k in range(40)] + [(1000 + k, f"other text {k}") for k in range(200)]
    for r in disclosure.find_personal(docs(rows)).collect():
        terms = [(s["start"], s["end"], s["remove"]) for s in r["spans"] if s["kind"] == "term"]
        assert terms == ([(0, 8, True)] if r["doc_id"] < 1000 else [])


def test_terms_anywhere_in_the_text_of_an_entity(docs):
    fill = " ".join(f"plain{k}" for k in range(30))
    rows = [(k, f"Zanzibar {fill} jo@firm.org {fill} é zanzibar") for k in range(3)]
    rows = [(k, f"{t} {k}") for k, t in rows] + [(10 + k, f"é {fill} {k}") for k in range(200)]
    out = {r["doc_id"]: r["spans"] for r in disclosure.find_personal(docs(rows)).collect()}
    for k, t in rows:
        assert sorted(t[s["start"] : s["end"]] for s in out[k] if s["kind"] == "term") == (["Zanzibar", "zanzibar"] if k < 3 else [])


def test_long_runs_take_linear_time(docs):
    text = "a" * 300_000 + " " + "1" * 300_000 + " " + "+1" + "(" * 300_000 + " " + "1." * 100_000
    assert disclosure.base_spans(text) is not None
    assert disclosure.emails("a@" * 100_000) == []


def test_empty_table(docs):
    assert disclosure.find_personal(docs([])).collect() == [] and disclosure.sanitise(docs([])).collect() == []


def brute_terms(rows):
    """Per row the spans of disclosing terms, by counting every entity with every word."""
    import math
    from collections import Counter

    word = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    lower = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x)
    small = lambda x: re.sub(r"[^a-z0-9@.]", "", x.lower())
    texts = {}
    for _, t in rows:
        t = t or ""
        if t not in texts:
            spans = brute(t)
            own = [(lower(m[0]), *m.span()) for m in word.finditer(lower(t))]
            free = [w for w in own if all(w[2] <= a or w[1] >= b for _, a, b in spans)]
            texts[t] = ({(k, small(t[a:b])) for k, a, b in spans}, {w[0] for w in own}, free)
    total = max(len(texts), 2)
    n_entity, n_term, n_both = Counter(), Counter(), Counter()
    for entities, own, free in texts.values():
        n_term.update(own)
        n_entity.update(entities)
        n_both.update((e, w) for e in entities for w in {w[0] for w in free})
    told = {}
    for (e, w), n in n_both.items():
        if n >= disclosure.SUPPORT:
            share = 1 - math.log(min(1, n / n_term[w])) / math.log(min(n_entity[e], total / 2) / total)
            if share >= disclosure.GENERALISE:
                told.setdefault(e, {})[w] = share
    out = []
    for i, t in rows:
        entities, _, free = texts[t or ""]
        best = Counter()
        for e in entities:
            for w, share in told.get(e, {}).items():
                best[w] = max(best[w], share)
        out.append((str(i), sorted((a, b, best[w] >= disclosure.REMOVE) for w, a, b in free if w in best)))
    return sorted(out)


def test_terms_are_those_of_brute_force(docs):
    rng = random.Random(5)
    people = [f"p{k}@firm{k % 3}.org" for k in range(6)]
    words = [f"w{k}" for k in range(40)] + ["é", "X", "日本"]
    rows = []
    for k in range(300):
        text = [rng.choice(words[:10]) for _ in range(6)]
        if k % 3 == 0:
            p = rng.randrange(6)
            text += [people[p], words[10 + p], rng.choice(words[16:]), words[-1 - p % 3] if p < 3 else "", people[(p + 1) % 6] if k % 2 else ""]
        rng.shuffle(text)
        rows.append((k, " ".join(text)))
    rows += [(1000 + k, t) for k, (_, t) in enumerate(rows[:40])] + ODD
    out = disclosure.find_personal(docs(rows, row=1, entity="x", group=2)).collect()
    found = sorted((str(r["doc_id"]), sorted((s["start"], s["end"], s["remove"]) for s in r["spans"] if s["kind"] == "term")) for r in out)
    assert found == brute_terms(rows) and sum(bool(x) for _, x in found) > 50


def test_a_page_of_many_entities_and_terms(docs):
    page = " ".join(f"name{k}@firm.org term{k}" for k in range(3000))
    out = disclosure.find_personal(docs([(k, f"{page} {k}") for k in range(4)] + [(10 + k, f"other text {k}") for k in range(50)])).collect()
    assert {r["doc_id"]: sum(s["kind"] == "term" for s in r["spans"]) for r in out if r["doc_id"] < 4} == dict.fromkeys(range(4), 3000)


def test_rows_keep_their_spans_when_the_input_is_split_anew(spark, tmp_path, monkeypatch):
    from tests.llm.conftest import splits_anew

    rows = [(k, f"Zanzibar note{k} jo@firm.org" if k % 50 == 0 else f"other text {k % 900}") for k in range(2000)]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(str(tmp_path / "t"))
    with splits_anew(spark, disclosure, monkeypatch):
        out = disclosure.find_personal(spark.read.parquet(str(tmp_path / "t")), of_files=True).collect()
    assert len(out) == 2000 and all([s["kind"] for s in r["spans"]] == (["email", "term"] if r["doc_id"] % 50 == 0 else []) for r in out)
