"""Personal data, and the terms that give it away, by information-theoretic sanitisation.

Protected entities are the values found by pattern (email, ip, card, phone). Over the whole corpus the
documents with an entity e, with a term t, and with both are counted. How strongly t discloses e is the
pointwise mutual information log(p(e,t) / (p(e) p(t))) as a share of e's own information -log p(e): 1 when t
occurs only beside e, 0 when it says nothing. In documents with e, a term at or above `threshold` becomes a
span, too: it is generalised to its beginning of three letters if that beginning stays below the threshold
for every such e, else removed. Estimates need `support` documents with both.

Terms are words (`\\w+`, lower case) of two letters or more outside the entities, counted once per document.
Of the same text, ties between terms do not matter, as each is judged by itself; very long texts are
scanned whole, in time linear in their length. Rows count as documents, repeated ones too. Null text is the empty text, a null id is an id like any other,
and an empty table gives no rows. Rows that share id and text get the same result. Other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowsieve.functions.tables import BROADCAST_ROWS
from flowsieve.functions.values import col
from flowsieve.llm.spans import Span, joined, private_spans, row_key, sha256_hex
from flowsieve.llm.tables import filled, free_names, id_text, id_type, join_large_groups, sliced, stored

THRESHOLD, SUPPORT, BEGINNING = 0.95, 3, 3
KINDS = ["email", "ip", "card", "phone", "general", "removed"]
BASE = KINDS[:4]
COUNTED_TERMS = 400_000
WORD = re.compile(r"\w\w+")
SPANS = "array<struct<kind:string,start:bigint,`end`:bigint>>"


def entity(kind: str, value: str) -> str:
    """One name for all ways to write a value."""
    return f"{kind}:{value.lower()}" if kind in ("email", "ip") else f"{kind}:" + "".join(c for c in value if c.isdigit())


def beginning(word: str) -> str:
    return word[:BEGINNING] + "*"


def words_outside(text: str, spans: list[Span]) -> dict[str, list[int]]:
    """Starts and ends (one after the other) of each lower-cased word that touches no span."""
    taken = sorted((a, b) for _, a, b in spans)
    found: dict[str, list[int]] = {}
    at = 0
    reach = 0
    for m in WORD.finditer(text):
        while at < len(taken) and taken[at][0] < m.end():
            reach = max(reach, taken[at][1])
            at += 1
        if reach <= m.start():
            found.setdefault(m.group().lower(), []).extend(m.span())
    return found


def scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: doc_id, key, base_sha256, base spans, entities, and for documents with entities the terms with their places."""
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    term = pa.struct([("term", pa.string()), ("places", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            columns: tuple[list, ...] = ([], [], [], [], [])
            for doc_id, value in zip(batch.column("doc_id").to_pylist(), filled(batch.column("text"))):
                text = value.as_py()
                base = private_spans(text)
                words = words_outside(text, base) if base else {}
                terms = [{"term": w, "places": p} for w, p in words.items()] + [{"term": b, "places": []} for b in {beginning(w) for w in words}]
                row = row_key(doc_id, text), sha256_hex(joined(base)), [dict(zip(("kind", "start", "end"), s)) for s in base], sorted({entity(k, text[a:b]) for k, a, b in base}), terms
                for column, v in zip(columns, row):
                    column.append(v)
            kinds = pa.binary(), pa.string(), pa.list_(span), pa.list_(pa.string()), pa.list_(term)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *map(pa.array, columns, kinds)], names=["doc_id", "key", "base_sha256", "base", "entities", "terms"])

    plain = id_text(docs, id_column, text_column)
    return plain.mapInArrow(run, f"doc_id {id_type(plain)}, key binary, base_sha256 string, base {SPANS}, entities array<string>, terms array<struct<term:string,places:array<bigint>>>")


def term_counts(docs: DataFrame, text_column: str = "text") -> DataFrame:
    """In how many documents each term and each beginning stands, over all documents: term, n. Summed up in each task first."""

    def out(counts: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["term", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        for batch in sliced(batches):
            for value in filled(batch.column("text")):
                text = value.as_py()
                words = words_outside(text, private_spans(text))
                counts.update(words.keys())
                counts.update({beginning(w) for w in words})
                if len(counts) > COUNTED_TERMS:
                    yield out(counts)
                    counts = Counter()
        yield out(counts)

    return docs.select(col(text_column).cast("string").alias("text")).mapInArrow(run, "term string, n bigint").groupBy("term").agg(F.sum("n").alias("n"))


def with_shared_entities(scanned: DataFrame, support: int = SUPPORT) -> tuple[DataFrame, DataFrame]:
    """Entities that enough documents have, with their counts; and key, terms and those entities of each document that has some.

    Entities that stand in the same documents disclose, and are disclosed, alike: one of them stands for all, so that a list
    of thousands of addresses is one entity. Documents are compared by their number and three sums of 32-bit hashes.
    """
    named = stored(scanned.select("key", F.explode("entities").alias("entity")), "entities")
    sums = [F.sum(F.pmod(F.xxhash64(F.lit(i), "key"), F.lit(1 << 32))).alias(f"sum_{i}") for i in range(3)]
    every = stored(named.groupBy("entity").agg(F.count("*").alias("n_entity"), *sums).filter(F.col("n_entity") >= support), "shared-entities")
    same = ["n_entity", *(f"sum_{i}" for i in range(3))]
    alike = every.groupBy(*same).agg(F.min("entity").alias("one"))
    groups = stored(every.join(alike, same).select("entity", "one", "n_entity"), "alike-entities")
    of_document = join_large_groups(named, groups, "entity", "n_entity", named.count()).groupBy("key").agg(F.collect_set("one").alias("shared"))
    entities = groups.filter("entity = one").select("entity", "n_entity")
    return entities, scanned.filter(F.size("entities") > 0).join(of_document, "key").select("key", "terms", F.col("shared").alias("entities"))


def disclosures(named: DataFrame, entities: DataFrame, counts: DataFrame, total: int, threshold: float = THRESHOLD, support: int = SUPPORT) -> DataFrame:
    """Entity, term, disclosure and generalised (whether the beginning may stay) of every term at or above the threshold."""
    together = beside(named).groupBy("entity", "term").agg(F.count("*").alias("n_both")).filter(F.col("n_both") >= support)
    measured = together.join(entities, "entity").join(counts.withColumnRenamed("n", "n_term"), "term")
    n = F.lit(float(max(1, total)))
    gained = F.log(F.col("n_both") * n / (F.col("n_entity") * F.col("n_term")))
    share = F.when(F.col("n_entity") < n, gained / F.log(n / F.col("n_entity"))).otherwise(0.0)
    over = stored(measured.select("entity", "term", share.alias("disclosure")).filter(F.col("disclosure") >= threshold), "disclosures")
    words = over.filter(~F.col("term").endswith("*")).withColumn("beginning", F.concat(F.substring("term", 1, BEGINNING), F.lit("*")))
    telling = over.filter(F.col("term").endswith("*")).select("entity", F.col("term").alias("beginning"), F.lit(True).alias("tells"))
    return words.join(telling, ["entity", "beginning"], "left").select("entity", "term", "disclosure", F.col("tells").isNull().alias("generalised"))


def beside(named: DataFrame) -> DataFrame:
    """Every entity of a document with every term of it: key, entity, term, places."""
    each = named.select("key", "terms", F.explode("entities").alias("entity"))
    return each.select("key", "entity", F.explode("terms").alias("t")).select("key", "entity", "t.term", "t.places")


def find_private(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", threshold: float = THRESHOLD, support: int = SUPPORT) -> DataFrame:
    """One row per document: doc_id, key, base_sha256, base and spans (base ones and those of disclosing terms), by kind, then start."""
    scanned = stored(scan(docs, id_column, text_column), "private-spans")
    entities, named = (stored(t, "shared-entities") for t in with_shared_entities(scanned, support))
    telling = stored(disclosures(named, entities, term_counts(docs, text_column), scanned.count(), threshold, support), "telling-terms")
    telling = F.broadcast(telling) if telling.count() <= BROADCAST_ROWS else telling
    met = beside(named).filter(F.size("places") > 0).join(telling, ["entity", "term"])
    words = met.groupBy("key", "term").agg(F.first("places").alias("places"), F.min("generalised").alias("generalised"))
    kind = F.when(F.col("generalised"), "general").otherwise("removed")
    pairs = F.transform(F.sequence(F.lit(1), F.size("places"), F.lit(2)), lambda i: F.struct(kind.alias("kind"), F.element_at("places", i).alias("start"), F.element_at("places", i + 1).alias("end")))
    added = words.select("key", pairs.alias("more")).groupBy("key").agg(F.flatten(F.collect_list("more")).alias("more"))
    rank = F.create_map(*[F.lit(x) for i, k in enumerate(KINDS) for x in (k, i)])
    merged = F.concat("base", F.coalesce("more", F.array().cast(SPANS)))
    ranked = F.array_sort(F.transform(merged, lambda s: F.struct(F.element_at(rank, s["kind"]).alias("order"), s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    spans = F.transform(ranked, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return scanned.join(added, "key", "left").select("doc_id", "key", "base_sha256", "base", spans.alias("spans"))


def cleaned(text: str, spans: list[dict]) -> str:
    """The text with entities named by kind, generalised terms cut to their beginning, and other disclosing terms left out.

    Where spans overlap, the one that starts first wins, and of those the longest.
    """
    parts, at = [], 0
    for s in sorted(spans, key=lambda s: (s["start"], -s["end"])):
        if s["start"] < at:
            continue
        word = text[s["start"] : s["end"]]
        parts += [text[at : s["start"]], "" if s["kind"] == "removed" else beginning(word) if s["kind"] == "general" else f"[{s['kind'].upper()}]"]
        at = s["end"]
    return "".join(parts) + text[at:]


def sanitise(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", threshold: float = THRESHOLD, support: int = SUPPORT) -> DataFrame:
    """The documents, all rows and columns, with sanitised text; null text stays null."""
    own, found_key, found_spans = free_names(docs, "own_key", "found_key", "found_spans")
    spans = find_private(docs, id_column, text_column, threshold, support).filter(F.size("spans") > 0)
    found = spans.groupBy(F.col("key").alias(found_key)).agg(F.first("spans").alias(found_spans)).hint("shuffle_hash")
    key = F.arrow_udf(lambda ids, texts: pa.array([row_key(i, t.as_py()) for i, t in zip(ids.to_pylist(), filled(texts))], pa.binary()), "binary")
    write = F.arrow_udf(lambda texts, found: pa.array([t if t is None or s is None else cleaned(t, s) for t, s in zip(texts.to_pylist(), found.to_pylist())], pa.string()), "string")
    keyed = docs.withColumn(own, key(col(id_column), col(text_column).cast("string")))
    joined_docs = keyed.join(found, F.col(own) == F.col(found_key), "left")
    return joined_docs.select(*[write(col(c).cast("string"), F.col(found_spans)).alias(c) if c == text_column else col(c) for c in docs.columns])
