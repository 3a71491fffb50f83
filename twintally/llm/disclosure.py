"""Personal data in texts, and the terms that disclose it.

Fixed patterns find protected entities. All of its text is the context of an entity; how many texts with the entity have
a term, and how many texts of the whole corpus have it at all, estimates how strongly it reveals the entity: the share of
the entity's information that the term gives, PMI(entity; term) / IC(entity) = 1 - IC(entity | term) / IC(entity).
Terms beyond ``REMOVE`` are removed, those beyond ``GENERALISE`` become a class of words.

Each document counts once for an entity and a term; documents with equal texts count once, also for a term's and the total
number. A pair needs ``SUPPORT`` such documents, and no entity with fewer is looked at. Every occurrence of a disclosing term
in a document with the entity is marked. All counts are of the whole corpus, added up by partial aggregates.

Entities that occur in exactly the same texts are one group, and so are terms that occur in the same ones of the texts with
entities; texts are joined by groups, so a page of many entities and terms gives few pairs. A pair of groups is only
formed if the entities' and terms' numbers allow the threshold.

Defined results: null texts are empty; repeated rows get equal spans; long texts are scanned whole; other columns don't
matter; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twintally.llm.frames import numbered
from twintally.llm.words import ALNUM, BYTE_VALUES, LOWER_VALUES, hash_runs, map_batches, mix, per_text, runs, slices
from twintally.sources.staging import scratch, stage

# Kinds in their order, and their patterns.
KINDS = ["email", "ip", "card", "phone", "term"]
LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

SUPPORT = 3
GENERALISE = 0.6
REMOVE = 0.85
COUNTED_AT_ONCE = 2_000_000
#: At most so many repeated texts (two numbers each) are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 500_000


def emails(text: str) -> list[tuple[int, int]]:
    """Matches of the e-mail pattern: each @ is tried once, with all of the local part before it."""
    found, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            found.append((start, domain.end()))
            free = domain.end()
        else:
            free = max(free, at + 1)
        at = text.find("@", free)
    return found


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of the fixed patterns, in code points."""
    found = [("email", *span) for span in emails(text)]
    found += [("ip", *m.span()) for m in IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
    for m in CARD.finditer(text) if re.search("[0-9]", text) else ():
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    found += [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= sum(map(str.isdigit, m[0])) <= 15]
    return found


SPAN = "array<struct<kind: string, start: bigint, end: bigint>>"
SPAN_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
WORDS = "array<struct<term: bigint, start: bigint, end: bigint>>"
WORDS_ARROW = pa.list_(pa.struct([("term", pa.int64()), ("start", pa.int64()), ("end", pa.int64())]))


def contexts(spans: list, text: str, points: np.ndarray, first: np.ndarray, end: np.ndarray, terms: np.ndarray) -> tuple[list[int], list[dict]]:
    """The entities of one text, and all its terms; words are given by their first and last bytes and their hashes."""
    start_point, end_point = points[first], points[end]
    # The words that overlap a span are a run of words.
    change = np.zeros(len(first) + 1, np.int64)
    entities = set()
    for kind, lo, hi in spans:
        a, b = np.searchsorted(end_point, lo, "right"), np.searchsorted(start_point, hi, "left")
        change[a] += 1
        change[max(a, b)] -= 1
        value = re.sub(r"[^a-z0-9@.]", "", text[lo:hi].lower())
        entities.add(int(hash_runs(np.frombuffer(f"{kind}:{value}".encode(), np.uint8), np.zeros(1, np.int64), np.array([len(kind) + 1 + len(value)]), BYTE_VALUES).view(np.int64)[0]))
    usable = np.flatnonzero(np.cumsum(change)[:-1] == 0).tolist()
    return sorted(entities), [{"term": int(terms[j]), "start": int(start_point[j]), "end": int(end_point[j])} for j in usable]


def numbered_texts(docs: DataFrame, id_col: str, text_col: str, of_files: bool, row_col: str | None) -> DataFrame:
    """(row, id, text, text_hash), the same at every reading."""
    columns = [F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), *([F.col(row_col).alias("row")] if row_col else [])]
    rows = docs.select(*columns)
    rows = rows if row_col else numbered(rows, "row", of_files)
    return rows.select("row", "id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("text_hash"))


def scan(rows: DataFrame) -> DataFrame:
    """(row, id, text_hash, spans, entities, words): protected entities, and all terms of the texts that have any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in slices(batch.column(2)):
                first, end, doc = runs(data, offsets, ALNUM)
                begin = per_text(doc, b - a)
                words = hash_runs(data, first, end, LOWER_VALUES).view(np.int64)
                points = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
                digits = np.concatenate(([0], np.cumsum((data >= 48) & (data <= 57))))[offsets]
                ats = np.concatenate(([0], np.cumsum(data == 64)))[offsets]
                spans, entities, terms = [], [], []
                for k in range(b - a):
                    own = slice(begin[k], begin[k + 1])
                    found, text = [], ""
                    # Every kind but e-mail has seven digits or more, or four numbers.
                    if digits[k + 1] - digits[k] >= 4 or ats[k + 1] > ats[k]:
                        text = data[offsets[k] : offsets[k + 1]].tobytes().decode()
                        found = base_spans(text)
                    spans.append([dict(zip(("kind", "start", "end"), s)) for s in found])
                    if found:
                        local = points[offsets[k] : offsets[k + 1] + 1] - points[offsets[k]]
                        of, near = contexts(found, text, local, first[own] - offsets[k], end[own] - offsets[k], words[own])
                    else:
                        of, near = [], []
                    entities.append(of)
                    terms.append(near)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), batch.column(1).slice(a, b - a), batch.column(3).slice(a, b - a), pa.array(spans, SPAN_ARROW), pa.array(entities, pa.list_(pa.int64())), pa.array(terms, WORDS_ARROW)],
                    ["row", "id", "text_hash", "spans", "entities", "words"],
                )

    return map_batches(rows, run, f"row bigint, id {rows.schema['id'].dataType.simpleString()}, text_hash bigint, spans {SPAN}, entities array<bigint>, words {WORDS}")


def term_documents(rows: DataFrame, copies: DataFrame) -> DataFrame:
    """(term, n): in how many different texts each word of the corpus occurs.

    ``copies`` has (text_hash, first) of the repeated texts; of these, only the row ``first`` counts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0
        for batch in batches:
            for _, _, data, offsets in slices(batch.column(0)):
                first, end, doc = runs(data, offsets, ALNUM)
                words = hash_runs(data, first, end, LOWER_VALUES)
                _, once = np.unique(words ^ mix(doc.astype(np.uint64) + np.uint64(1)), return_index=True)
                held.append(words[once])
                size += len(once)
            if size > COUNTED_AT_ONCE:
                yield counted(held)
                held, size = [], 0
        if size:
            yield counted(held)

    def counted(held: list[np.ndarray]) -> pa.RecordBatch:
        terms, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(n, pa.int64())], ["term", "n"])

    copies = F.broadcast(copies) if copies.count() <= BROADCAST_ROWS else copies
    once = rows.join(copies, "text_hash", "left").where("first IS NULL OR row = first")
    return map_batches(once.select("text"), run, "term bigint, n bigint").groupBy("term").agg(F.sum("n").alias("n"))


def same_rows(table: DataFrame, name: str, group: str) -> DataFrame:
    """(name, group): equal groups stand in exactly the same rows of ``table`` (row, name), by 128 bits of hashes."""
    sums = [F.bit_xor(F.xxhash64(F.lit(k), "row")).alias(f"x{k}") for k in (1, 2)]
    return table.groupBy(name).agg(F.count("*").alias("n"), *sums).select(name, "n", F.xxhash64("n", "x1", "x2").alias(group))


def disclosing(scanned: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entity, group) and (group, term, share): terms that give at least ``GENERALISE`` of the information of a group's entities."""
    texts = stage(scanned.groupBy("text_hash").agg(F.min("row").alias("first"), F.count("*").alias("n_copies")), "texts")
    total = float(max(texts.count(), 2))
    # One row of each text; the rows' numbers are the same at every reading.
    once = scanned.where(F.size("entities") > 0).join(texts.select(F.col("first").alias("row")), "row", "left_semi")
    holds = stage(once.select("row", F.explode("entities").alias("entity")), "entities-of-texts")
    entities = stage(same_rows(holds, "entity", "group").where(F.col("n") >= SUPPORT), "entities", keep=True)
    most = entities.agg(F.max("n")).first()[0] or 0
    holds = stage(holds.join(entities, "entity").select("row", "group", F.col("n").alias("n_entity")).distinct(), "groups-of-texts")

    def bound(n: Column) -> Column:
        """A term in more texts than this can't give an entity of n texts away, even if it is in all of them."""
        return n * F.pow(F.least(n, F.lit(total / 2)) / total, F.lit(GENERALISE - 1)) + 1

    terms = term_documents(rows, stage(texts.where("n_copies > 1").select("text_hash", "first"), "copies"))
    terms = stage(terms.where((F.col("n") >= SUPPORT) & (F.col("n") <= bound(F.lit(float(most))))) if most else terms.limit(0), "terms")
    words = once.join(holds.select("row").distinct(), "row", "left_semi").select("row", F.explode(F.array_distinct("words.term")).alias("term"))
    words = stage(words.join(terms, "term"), "terms-of-texts")
    kinds = same_rows(words.select("row", "term"), "term", "kind").where(F.col("n") >= SUPPORT)
    kinds = stage(kinds.select("term", "kind").join(terms, "term"), "kinds-of-terms")
    # Of a kind's terms, the rarest has the best chance.
    places = words.select("row", "term").join(kinds, "term").groupBy("row", "kind").agg(F.min("n").alias("least"))
    met = holds.join(places, "row").where(F.col("least") <= bound(F.col("n_entity").cast("double")))
    met = met.groupBy("group", "kind", "n_entity").agg(F.count("*").alias("n_both")).where(F.col("n_both") >= SUPPORT)
    given = F.least(F.lit(1.0), F.col("n_both") / F.col("n"))
    share = 1 - F.log(given) / F.log(F.least(F.col("n_entity").cast("double"), F.lit(total / 2)) / total)
    told = met.join(kinds, "kind").withColumn("share", share).where(F.col("share") >= GENERALISE)
    return entities.select("entity", "group"), told.select("group", "term", "share")


def find_personal(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", of_files: bool = False, row_col: str | None = None) -> DataFrame:
    """One row per document: row, id and ``spans`` (kind, start, end, remove); terms that disclose an entity have kind term.

    ``of_files``: see ``numbered``. ``row_col``: a column of such numbers that ``docs`` has already.
    """
    rows = numbered_texts(docs, id_col, text_col, of_files, row_col)
    scanned = stage(scan(rows), "personal", keep=True)
    with scratch(docs.sparkSession):
        entities, pairs = disclosing(scanned, rows)
        pairs = stage(pairs, "disclosing")
        holds = scanned.select("row", F.explode("entities").alias("entity")).join(entities, "entity").select("row", "group").distinct()
        told = holds.join(pairs, "group").groupBy("row", "term").agg(F.max("share").alias("share"))
        told = stage(told, "disclosing-terms", keep=True)
    words = scanned.where(F.size("entities") > 0).join(told.select("row").distinct(), "row", "left_semi")
    found = words.select("row", F.explode("words").alias("x")).select("row", "x.*").join(told, ["row", "term"])
    span = lambda kind, s, remove: F.struct(kind.alias("kind"), s["start"].alias("start"), s["end"].alias("end"), remove.alias("remove"))
    term = span(F.lit("term"), {"start": F.col("start"), "end": F.col("end")}, F.col("share") >= REMOVE)
    found = found.groupBy("row").agg(F.collect_list(term).alias("terms"))
    base = F.transform("spans", lambda s: span(s["kind"], s, F.lit(False)))
    spans = F.concat(base, F.coalesce("terms", F.array().cast("array<struct<kind: string, start: bigint, end: bigint, remove: boolean>>")))
    return scanned.select("row", "id", "spans").join(found, "row", "left").select("row", F.col("id").alias(id_col), spans.alias("spans"))


def sanitised(text: Column, spans: Column) -> Column:
    """The text with its spans replaced: entities by their kind, terms by a class of words or by nothing.

    Overlapping spans are replaced as one, by the first one's text.
    """
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("less"), s["kind"].alias("kind"), s["remove"].alias("remove"))))
    word = lambda s: F.substring(text, s["start"].cast("int") + 1, (-s["less"] - s["start"]).cast("int"))
    general = lambda s: F.when(word(s).rlike("^[0-9]"), "[NUMBER]").when(word(s).rlike("^\\p{Lu}"), "[NAME]").otherwise("[WORD]")
    mark = lambda s: F.when(s["kind"] != "term", F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))).when(s["remove"], "").otherwise(general(s))
    done = F.aggregate(
        ordered,
        F.struct(F.lit("").alias("out"), F.lit(0).cast("bigint").alias("at")),
        lambda a, s: F.when(s["start"] < a["at"], F.struct(a["out"].alias("out"), F.greatest(a["at"], -s["less"]).alias("at"))).otherwise(
            F.struct(
                F.concat(a["out"], F.substring(text, a["at"].cast("int") + 1, (s["start"] - a["at"]).cast("int")), mark(s)).alias("out"), (-s["less"]).alias("at")
            )
        ),
        lambda a: F.concat(a["out"], F.substring(text, a["at"].cast("int") + 1, F.length(text))),
    )
    return F.when(F.size(spans) == 0, text).otherwise(done)


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with sanitised texts; the rows are written once, so that spans and texts belong together."""
    name = "__personal_row"
    rows = numbered(docs, name)
    spans = find_personal(rows, id_col, text_col, row_col=name).select(F.col("row").alias(name), F.col("spans").alias("__spans"))
    out = rows.join(spans, name)
    return out.withColumn(text_col, sanitised(F.col(text_col), F.col("__spans"))).select(*docs.columns)
