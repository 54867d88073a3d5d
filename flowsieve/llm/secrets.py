"""Secret scans with multipart credential linking.

A credential has parts: an access identifier, a secret, an endpoint. Strong parts are reported as such:
assigned secrets, access key ids and long hex runs. Weak parts say little alone: a login name or an email
address (identifier), a token that looks random (secret), a host with port, a URL or an IP address (endpoint).
A weak part is reported only if a complementary part stands in its scope: the same document, starts at most
`scope` code points apart. A weak secret needs an identifier or an endpoint, the other two need a secret.

Left out as weak parts: secrets of fewer than 16 characters, of one kind of letter with hardly a digit (a passphrase,
say), or with too few bits a character; hosts without a numeric port unless in a URL; URLs whose scheme is not of 2
to 10 lower-case letters; IPv6 addresses.

The interval join goes by cells of `scope` code points. For each document, role and cell only the first and
last start are kept; these decide for the cells next to a candidate's, and any part in its own cell is
in scope. So a candidate meets at most six rows, however many parts a text holds.

Null text is the empty text and has no spans. Rows that share id and text get the same result. An empty
table gives no rows. Other columns are not read. Texts are read whole.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowsieve.llm.spans import Span, emails, private_spans, row_key, secret_spans, sha256_hex, joined
from flowsieve.llm.tables import filled, id_text, id_type, sliced, stored

SCOPE = 256
ROLE = {"assign": "secret", "access": "identifier", "hex": "secret", "login": "identifier", "email": "identifier", "token": "secret", "host": "endpoint", "url": "endpoint", "ip": "endpoint"}
ORDER = list(ROLE)
BASE = ORDER[:3]
NEEDS = {"identifier": ["secret"], "endpoint": ["secret"], "secret": ["identifier", "endpoint"]}

LOGIN = re.compile(r"(?<![A-Za-z])(?:user(?:_?name|_?id)?|login|account|client_?id)[\"']?\x20*+[:=]\x20*+[\"']?[A-Za-z0-9_.@-]{3,}+", re.IGNORECASE | re.ASCII)
TOKEN = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}+={0,2}")
URL = re.compile(r"(?<![a-z])[a-z]{2,10}://[^\s\"'<>]++")
HOST = re.compile(r"(?<![A-Za-z0-9.-])[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++:[0-9]{2,5}(?![0-9])")
# The kind of character changes inside a word: between letters and digits, or of case other than after a leading capital.
CHANGE = re.compile(r"(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])|(?<=[a-z])(?=[A-Z])|(?<=[A-Z][A-Z])(?=[a-z])")
LEAST_ENTROPY, ENTROPY_SHARE, CHANGES_SHARE = 3.2, 0.7, 1 / 6


def looks_random(token: str) -> bool:
    """Enough bits a character for the length, and letters mixed with three digits or with other kinds of character often enough."""
    n, digits = len(token), sum(c.isdigit() for c in token)
    if digits == n or not (digits >= 3 or sum(1 for _ in CHANGE.finditer(token)) >= CHANGES_SHARE * n):
        return False
    counts = Counter(token).values()
    return -sum(k / n * math.log2(k / n) for k in counts) >= min(LEAST_ENTROPY, ENTROPY_SHARE * math.log2(n))


def weak_spans(text: str, strong: list[Span]) -> list[Span]:
    """Weak parts that overlap no strong span."""
    found: list[Span] = [("login", *m.span()) for m in LOGIN.finditer(text)]
    found += [("email", a, b) for a, b in emails(text)]
    found += [("token", *m.span()) for m in TOKEN.finditer(text) if looks_random(m.group())]
    found += [("host", *m.span()) for m in HOST.finditer(text)]
    if "://" in text:
        found += [("url", *m.span()) for m in URL.finditer(text)]
    found += [s for s in private_spans(text) if s[0] == "ip"] if found or strong else []
    taken = sorted((a, b) for _, a, b in strong)
    starts, reach = [a for a, _ in taken], [0, *accumulate((b for _, b in taken), max)]
    return [s for s in found if reach[bisect_left(starts, s[2])] <= s[1]]  # how far those that start before its end reach


def scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per document: doc_id, key, base_sha256 and all its parts, strong ones first."""
    part = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            keys, hashes, parts = [], [], []
            for doc_id, value in zip(batch.column("doc_id").to_pylist(), filled(batch.column("text"))):
                text = value.as_py()
                strong = secret_spans(text)
                keys.append(row_key(doc_id, text))
                hashes.append(sha256_hex(joined(strong)))
                parts.append([dict(zip(("kind", "start", "end"), s)) for s in [*strong, *weak_spans(text, strong)]])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(keys, pa.binary()), pa.array(hashes, pa.string()), pa.array(parts, pa.list_(part))], names=["doc_id", "key", "base_sha256", "parts"]
            )

    plain = id_text(docs, id_column, text_column)
    return plain.mapInArrow(run, f"doc_id {id_type(plain)}, key binary, base_sha256 string, parts array<struct<kind:string,start:bigint,`end`:bigint>>")


def by_kind(kind: Column, values: dict) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) if isinstance(x, (str, int)) else F.array(*map(F.lit, x)) for pair in values.items() for x in pair]), kind)


def linked_parts(scanned: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Weak parts with a complementary part in scope: key, kind, start, end, and the nearest such part's role and start."""
    parts = scanned.filter(F.size("parts") > 1).select("key", F.explode("parts").alias("p")).select("key", "p.kind", "p.start", "p.end")
    placed = parts.withColumns({"role": by_kind(F.col("kind"), ROLE), "cell": F.floor(F.col("start") / scope)})
    cells = placed.groupBy("key", "role", "cell").agg(F.min("start").alias("first"), F.max("start").alias("last"))
    weak = placed.filter(~F.col("kind").isin(BASE)).distinct()
    wanted = weak.select("key", "kind", "start", "end", F.explode(by_kind(F.col("role"), NEEDS)).alias("role"), F.col("cell").alias("own"))
    looked = wanted.select("*", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))).alias("step")).withColumn("cell", F.col("own") + F.col("step"))
    partner = F.when(F.col("step") < 0, F.col("last")).otherwise(F.col("first"))
    met = looked.join(cells, ["key", "role", "cell"]).withColumn("partner", partner)
    near = met.withColumn("distance", F.abs(F.col("partner") - F.col("start"))).filter(F.col("distance") <= scope)
    nearest = F.min(F.struct("distance", "role", "partner")).alias("best")
    return near.groupBy("key", "kind", "start", "end").agg(nearest).select("key", "kind", "start", "end", F.col("best.role").alias("partner_role"), F.col("best.partner").alias("partner_start"))


def find_secrets(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", scope: int = SCOPE) -> DataFrame:
    """One row per document: doc_id, key, base_sha256, base (strong spans) and spans (with the linked weak ones), by start and kind."""
    scanned = stored(scan(docs, id_column, text_column), "secret-parts")
    linked = linked_parts(scanned, scope).groupBy("key").agg(F.collect_list(F.struct("kind", "start", "end")).alias("linked"))
    strong = F.filter("parts", lambda p: p["kind"].isin(BASE))
    merged = F.concat(strong, F.coalesce("linked", F.array().cast("array<struct<kind:string,start:bigint,`end`:bigint>>")))
    ranked = F.array_sort(F.transform(merged, lambda p: F.struct(p["start"].alias("start"), by_kind(p["kind"], {k: i for i, k in enumerate(ORDER)}).alias("order"), p["end"].alias("end"), p["kind"].alias("kind"))))
    spans = F.transform(ranked, lambda p: F.struct(p["kind"].alias("kind"), p["start"].alias("start"), p["end"].alias("end")))
    return scanned.join(linked, "key", "left").select("doc_id", "key", "base_sha256", strong.alias("base"), spans.alias("spans"))
