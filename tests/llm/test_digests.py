"""The queries' own columns, over a whole small table, against plain Python."""

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest

from tests.llm import test_credentials, test_disclosure
from tests.llm.test_packing import TOKENIZER
from twintally.llm.queries import QUERIES

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()}


def digest(parts):
    return hashlib.sha256(",".join(parts).encode()).hexdigest()


def test_secrets(spark, texts):
    kinds = ["assign", "access", "hex", "grammar"]
    rows = QUERIES["op5_grammar_secrets"](spark, SMALL).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = sorted(test_credentials.brute(texts[r["doc_id"]]), key=lambda s: (s[1], kinds.index(s[0])))
        spelled = [f"{k}:{a}:{b}" for k, a, b in base]
        assert r["base_sha256"] == digest(spelled)
        assert [r[f"n_{k}"] for k in kinds[:3]] == [sum(s[0] == k for s in base) for k in kinds[:3]]
        every = [s for s in r["spans"].split(",") if s]
        assert [s for s in every if not s.startswith("grammar")] == spelled
        assert every == sorted(every, key=lambda s: (int(s.split(":")[1]), kinds.index(s.split(":")[0])))


def test_personal_data(spark, texts):
    kinds = ["email", "ip", "card", "phone", "term"]
    rows = QUERIES["op6_disclosure"](spark, SMALL).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = sorted(test_disclosure.brute(texts[r["doc_id"]]), key=lambda s: (kinds.index(s[0]), s[1]))
        spelled = [f"{k}:{a}:{b}" for k, a, b in base]
        assert r["base_sha256"] == digest(spelled)
        assert [r[f"n_{k}"] for k in kinds[:4]] == [sum(s[0] == k for s in base) for k in kinds[:4]]
        assert [s for s in r["spans"].split(",") if s and not s.startswith("term")] == spelled


def test_packing(spark, texts):
    rows = QUERIES["op8_bounded_best_fit"](spark, SMALL).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["piece"])):
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(pieces) == set(texts)
    for k, own in pieces.items():
        ids = np.array([*TOKENIZER.encode(texts[k] or "", add_special_tokens=False).ids, 2], "<u4")
        assert [r["piece"] for r in own] == list(range(len(own))) and len(own) == -(-len(ids) // 1024)
        at = 0
        for r in own:
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids) and all(r["length"] == 1024 for r in own[1:])
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024


def test_shards(spark, texts):
    rows = QUERIES["op9_hypergeometric_shards"](spark, SMALL).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    shards = defaultdict(list)
    for r in rows:
        own = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(own) + 8, zlib.crc32(own), "rows", None)
        shards[r["shard"]].append(r["slot"])
    assert set(shards) <= set(range(24)) and all(sorted(x) == list(range(len(x))) for x in shards.values())
    assert max(map(len, shards.values())) - min(len(shards.get(k, [])) for k in range(24)) <= 1


def test_urls(spark):
    rules = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
    pages = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{SMALL}/pages.parquet").select("page_id", "url").collect()}
    rows = QUERIES["op3_boosted_urls"](spark, SMALL).collect()
    assert len(rows) == len(pages)
    for r in rows:
        rest = (pages[r["page_id"]] or "").partition("://")[2]
        cut = lambda text, marks: next((k for k, c in enumerate(text) if c in marks), len(text))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[: cut(rest, "/?#")])
        path = rest[cut(rest, "/?#") :]
        path = path[: cut(path, "?#")]
        fitting = [(len(h + p), v, h + p) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert (r["host"], r["path"]) == (host, path) and r["rule"] == (max(fitting)[2] if fitting else None)
        assert r["verdict"] == max(fitting)[1] if fitting else r["verdict"] in ("allow", "block")
