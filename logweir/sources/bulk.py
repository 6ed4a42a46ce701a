"""Bulk input: lines of JSON in pairs of an action and a document."""

from __future__ import annotations

import gzip
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Actions of a bulk, and the number of action lines that are looked at.
ACTIONS, LOOKED_AT = ("create", "index"), 5
DOCUMENT_BYTES = 128 * 1024
#: An action and no document: an object whose only key is an action, with a flat object as its value.
_ACTION = r'^\s*\{\s*"(create|index)"\s*:\s*\{[^{}]*\}\s*\}\s*$'


class BulkError(ValueError):
    pass


def parse(body: bytes, most_bytes: int = DOCUMENT_BYTES) -> list[str]:
    """The documents of a request's body, which may be gzipped; those over ``most_bytes`` are left out."""
    if body[:2] == b"\x1f\x8b":
        body = gzip.decompress(body)
    lines = iter(body.decode("utf-8").split("\n"))
    out, seen = [], 0
    for action in lines:
        if not action.strip():
            continue
        seen += 1
        if seen <= LOOKED_AT and not any(f'"{a}"' in action for a in ACTIONS):
            raise BulkError(f"unexpected action line {action[:100]!r}")
        doc = next(lines, "").strip()
        if not doc:
            raise BulkError("a document is missing after its action")
        if len(doc.encode()) <= most_bytes:
            out.append(doc)
    return out


def response(count: int, took_ms: int) -> dict:
    """The answer to a bulk request."""
    return {"took": took_ms, "errors": False, "items": [{"create": {"status": 201}}] * count}


def requests(bodies: DataFrame, most_bytes: int = DOCUMENT_BYTES) -> DataFrame:
    """(bulk, pos, doc, reason) of whole request bodies (value): lines in turn are an action and its document.

    bulk: a hash of the body, so that a retried request has the same one; pos: the place of
    the document in it.  reason is null for documents; it names what is left out: a document
    over ``most_bytes``, or all of a body with another line where an action should be (doc
    is null then).
    """
    body = F.col("value")
    lines = F.filter(F.split(body, "\\r?\\n"), lambda x: F.trim(x) != "")
    actions, docs = F.filter(lines, lambda _, i: i % 2 == 0), F.filter(lines, lambda _, i: i % 2 == 1)
    known = F.forall(F.slice(actions, 1, LOOKED_AT), lambda x: F.contains(x, F.lit('"create"')) | F.contains(x, F.lit('"index"')))
    rows = bodies.select(F.xxhash64(body).alias("bulk"), F.when(~known, "unexpected action line").when(F.size(lines) % 2 == 1, "a document is missing after its action").alias("wrong"), docs.alias("docs"))
    each = F.when(F.col("wrong").isNull(), F.col("docs")).otherwise(F.array(F.lit(None).cast("string")))
    rows = rows.select("bulk", "wrong", F.posexplode(each).alias("pos", "doc"))
    return rows.select("bulk", "pos", "doc", F.coalesce("wrong", F.when(F.octet_length("doc") > most_bytes, "document is too large")).alias("reason"))


def documents(lines: DataFrame, most_bytes: int = DOCUMENT_BYTES) -> DataFrame:
    """(doc) of lines (value) that come in any order: those that are neither blank nor an action.

    Lines need no partner, so files may be split anywhere; a document that has nothing but
    the key ``create`` or ``index`` with a flat object cannot be told from an action here.
    """
    line = F.col("value")
    keep = (F.trim(line) != "") & ~line.rlike(_ACTION) & (F.octet_length(line) <= most_bytes)
    return lines.filter(keep).select(line.alias("doc"))


def read(spark: SparkSession, path: str, most_bytes: int = DOCUMENT_BYTES) -> DataFrame:
    """(bulk, pos, doc, reason) of files of which each is a request's body, gzipped or not."""
    return requests(spark.read.text(path, wholetext=True), most_bytes)


def read_lines(spark: SparkSession, path: str, most_bytes: int = DOCUMENT_BYTES) -> DataFrame:
    """(doc) of JSON-lines files without actions, gzipped or not: every line that is not blank."""
    line = F.col("value")
    return spark.read.text(path).filter((F.trim(line) != "") & (F.octet_length(line) <= most_bytes)).select(line.alias("doc"))


def is_object(doc: Column) -> Column:
    """Whether a text is a JSON object; null if it is no JSON at all."""
    return F.schema_of_variant(F.try_parse_json(doc)).startswith("OBJECT")


def judged(docs: DataFrame) -> DataFrame:
    """docs with the reason why one is left out, null for JSON objects; a reason that is there stays."""
    fine = is_object(F.col("doc"))
    why = F.when(fine.isNull(), "invalid JSON").when(~fine, "not an object")
    return docs.withColumn("reason", F.coalesce(F.col("reason"), why) if "reason" in docs.columns else why)


def split_valid(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(objects, (doc, reason) of what is left out)."""
    rows = judged(docs)
    return rows.filter("reason IS NULL").drop("reason"), rows.filter("reason IS NOT NULL").select("doc", "reason")


def sample(docs: list[dict]) -> bytes:
    """A request's body for documents."""
    return "".join('{"index":{}}\n' + json.dumps(d) + "\n" for d in docs).encode()
