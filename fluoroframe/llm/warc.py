"""Web archives of page records, and archives in which equal payloads are kept once.

An archive is a folder of gzip-compressed WARC 1.1 files that Spark's text writer and reader handle on any store: the
two line ends after every record are the separator of its rows.  The separator also occurs inside records, so a reader
puts the rows of a file together again and follows the lengths in the headers, one record at a time.

Revisits are resolved on headers alone.  They are shuffled by payload digest, the least record of each digest is the
original, and the headers of the others join it and become revisit records without payload that refer to it.  Of each
payload one copy leaves a task, however many the task has read, and moves once to be written under the original's
fresh headers.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from datetime import datetime, timezone

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from fluoroframe.llm.common import filled
from fluoroframe.plans.cut import cut, forget

END = "\r\n"
GAP = "\r\n\r\n"
# Names and lines of the format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "
#: Payloads of fewer bytes are never revisits.
LEAST_BYTES = 100
#: Rows that repeat each other are laid out so many at a time.
SAME_ROWS = 1 << 14
RECORD = (
    "record_id string, record_type string, page_id long, url string, date string, payload_digest string, payload_bytes long, "
    "refers_to_record string, refers_to_url string, refers_to_date string"
)


def _line(name: str, value: Column) -> Column:
    """A header line, none for null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(END)), F.lit(""))


def _url_lines(name: str, url: Column) -> Column:
    """Target address: controls and outer spaces are percent-encoded for other readers, then the exact text follows in base64."""
    odd = url.rlike(r"[\x00-\x20\x7f-\x{10FFFF}]|^$")
    exact = F.when(odd, F.base64(F.encode(url, "UTF-8")))
    safe = F.when(odd, F.url_encode(url)).otherwise(url)
    return F.concat(_line(name, safe), _line(f"X-{name}-Base64", F.regexp_replace(exact, r"\s", "")))


def _record(payload: Column) -> Column:
    """One record, without the gap that ends it; ``payload`` is null for a revisit."""
    http = F.concat(F.lit(HTTP_HEAD), F.col("payload_bytes").cast("string"), F.lit(GAP))
    size = F.octet_length(http).cast("long") + F.when(payload.isNull(), 0).otherwise(F.col("payload_bytes"))
    return F.concat(
        F.lit(VERSION + END),
        _line("WARC-Type", F.col("record_type")),
        _line("WARC-Record-ID", F.concat(F.lit("<"), "record_id", F.lit(">"))),
        _line("WARC-Date", F.col("date")),
        _url_lines("WARC-Target-URI", F.col("url")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "payload_digest")),
        _line("WARC-Refers-To", F.concat(F.lit("<"), "refers_to_record", F.lit(">"))),
        _url_lines("WARC-Refers-To-Target-URI", F.col("refers_to_url")),
        _line("WARC-Refers-To-Date", F.col("refers_to_date")),
        _line("WARC-Profile", F.when(F.col("record_type") == "revisit", F.lit(PROFILE))),
        _line("X-Page-ID", F.col("page_id").cast("string")),
        _line("Content-Type", F.lit("application/http;msgtype=response")),
        _line("Content-Length", size.cast("string")),
        F.lit(END),
        http,
        F.coalesce(payload, F.lit("")),
    )


def _save(records: DataFrame, path: str) -> None:
    records.select(_record(F.col("body")).alias("value")).write.option("lineSep", GAP).option("compression", "gzip").text(path)


def _captures(pages: DataFrame, id_column: str, url_column: str, payload_column: str, date_column: str | None) -> DataFrame:
    """``page_id, url, date, payload_digest, payload_bytes, body`` of every row; one time of capture if no column tells it."""
    now = datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    body = filled(payload_column)
    return pages.select(
        F.col(f"`{id_column}`").cast("long").alias("page_id"),
        F.col(f"`{url_column}`").cast("string").alias("url"),
        (F.lit(now) if date_column is None else F.coalesce(F.col(f"`{date_column}`").cast("string"), F.lit(now))).alias("date"),
        F.sha2(F.encode(body, "UTF-8"), 256).alias("payload_digest"),
        F.octet_length(body).cast("long").alias("payload_bytes"),
        body.alias("body"),
    )


def _named(digest: str, *parts: str) -> Column:
    """Record id that follows from the payload and its original."""
    text = F.sha2(F.concat_ws("|", digest, *[F.coalesce(F.col(p).cast("string"), F.lit("-")) for p in parts]), 256)
    return F.regexp_replace(F.substring(text, 1, 32), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "urn:uuid:$1-$2-$3-$4-$5")


_HEADERS = ["record_id", "record_type", "page_id", "url", "date", "payload_digest", "payload_bytes", "refers_to_record", "refers_to_url", "refers_to_date"]


def _responses(captures: DataFrame, record_id: Column) -> DataFrame:
    empty = {c: F.lit(None).cast("string") for c in _HEADERS[-3:]}
    return captures.withColumns({"record_id": record_id, "record_type": F.lit("response"), **empty}).select(*_HEADERS, "body")


def write_archives(
    pages: DataFrame, path: str, id_column: str = "page_id", url_column: str = "url", payload_column: str = "html", date_column: str | None = None
) -> None:
    """One response record per row, the payload in UTF-8 (null: empty), ids and addresses null where they are.

    Other columns are left behind.
    """
    captures = _captures(pages, id_column, url_column, payload_column, date_column)
    _save(_responses(captures, F.concat(F.lit("urn:uuid:"), F.uuid())), path)


def write_once(
    pages: DataFrame, path: str, id_column: str = "page_id", url_column: str = "url", payload_column: str = "html", date_column: str | None = None,
    least_bytes: int = LEAST_BYTES,
) -> None:
    """One record per row, but of equal payloads of at least ``least_bytes`` only the original is a response.

    The original is the row with the smallest page id (null ids last), then the smallest address and date; all others,
    rows that repeat it too, are revisits of it.  ``pages`` is read twice and has to give the same rows; the rows of
    several archives (``read_archives`` with payload, without revisits) may be put together first.  Other columns are
    left behind.
    """
    captures = _captures(pages, id_column, url_column, payload_column, date_column)
    large = captures.where(F.col("payload_bytes") >= least_bytes)
    headers = cut(large.drop("body"))
    first = originals(headers)
    revisits = find_revisits(headers, first).withColumn("record_type", F.lit("revisit")).withColumn("record_id", F.concat(F.lit("urn:uuid:"), F.uuid()))
    bodies = large.groupBy("payload_digest").agg(F.first("body").alias("body"), F.min(_order()).alias("o"), F.first("payload_bytes").alias("payload_bytes"))
    responses = _responses(bodies.select("payload_digest", "payload_bytes", "body", "o.page_id", "o.url", "o.date"), _named("payload_digest", "page_id", "url", "date"))
    small = _responses(captures.where(F.col("payload_bytes") < least_bytes), F.concat(F.lit("urn:uuid:"), F.uuid()))
    _save(small.unionByName(responses).unionByName(revisits.withColumn("body", F.lit(None).cast("string"))), path)
    forget(headers)


def _order() -> Column:
    return F.struct(F.col("page_id").isNull().alias("none"), F.col("page_id"), F.col("url"), F.col("date"))


def originals(headers: DataFrame) -> DataFrame:
    """``payload_digest, first, copies`` of every payload that several records have; ``first`` is the original's order."""
    return headers.groupBy("payload_digest").agg(F.min(_order()).alias("first"), F.count("*").alias("copies")).where("copies > 1")


def find_revisits(headers: DataFrame, first: DataFrame) -> DataFrame:
    """Headers of all revisits, with the record, address and date of the original.

    Rows that repeat each other are counted, and the original is taken off once.
    """
    # one row per digest in ``first``; adaptive execution splits the headers of a payload that very many records have
    met = headers.join(first, "payload_digest")
    counted = met.groupBy("page_id", "url", "date", "payload_digest", "payload_bytes", "first").agg(F.count("*").alias("times"))
    is_first = _order().eqNullSafe(F.col("first"))
    left = counted.withColumn("times", F.col("times") - F.when(is_first, 1).otherwise(0)).where("times > 0")
    parts = left.withColumn("_m", F.explode(F.sequence(F.lit(0), F.col("times") - 1, F.lit(SAME_ROWS))))
    rows = parts.withColumn("_n", F.explode(F.sequence(F.lit(1), F.least(F.col("times") - F.col("_m"), F.lit(SAME_ROWS)))))
    told = rows.select("page_id", "url", "date", "payload_digest", "payload_bytes", F.col("first.page_id").alias("_p"), F.col("first.url").alias("refers_to_url"), F.col("first.date").alias("refers_to_date"))
    return told.withColumn("refers_to_record", _named("payload_digest", "_p", "refers_to_url", "refers_to_date")).drop("_p")


def parse(rows: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of a stream that was cut at every gap."""
    gap, data, ended = GAP.encode(), bytearray(), False
    rows = iter(rows)

    def more() -> bool:
        nonlocal ended
        row = next(rows, None)
        ended = row is None
        if not ended:
            data.extend(row)
            data.extend(gap)
        return not ended

    while True:
        while True:  # line ends between records
            del data[: len(data) - len(data.lstrip(b"\r\n"))]
            if data or not more():
                break
        if not data:
            return
        while (cut := data.find(gap)) < 0:
            if not more():
                raise ValueError("a record ends inside its headers")
        lines = data[:cut].decode("utf-8").split(END)
        if not lines[0].startswith("WARC/"):
            raise ValueError("a record does not begin with its version")
        heads = dict(line.split(": ", 1) for line in lines[1:])
        size = int(heads["Content-Length"])
        while len(data) < cut + len(gap) + size:
            if not more():
                raise ValueError("a record ends inside its block")
        begin = cut + len(gap)
        yield heads, bytes(data[begin : begin + size])
        del data[: begin + size]


def _url(heads: dict[str, str], name: str) -> str | None:
    exact = heads.get(f"X-{name}-Base64")
    return heads.get(name) if exact is None else base64.b64decode(exact).decode("utf-8")


def read_archives(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """One row per record of the archives in a folder: the fields of ``RECORD`` and, if wanted, ``payload``.

    A revisit has the size and digest of its full payload, and no payload of its own (null).  Compressed files are
    not split, so the rows of each come in order, whatever its size.
    """
    names = [f.split(" ")[0] for f in RECORD.split(", ")] + ["payload"] * with_payload

    def records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, held = [], 0
        for heads, block in parse(r.encode("utf-8") for b in batches for r in b["value"]):
            http, _, payload = block.partition(GAP.encode())
            kind, page, refers = heads["WARC-Type"], heads.get("X-Page-ID"), heads.get("WARC-Refers-To")
            row = (
                heads["WARC-Record-ID"][1:-1], kind, None if page is None else int(page), _url(heads, "WARC-Target-URI"), heads["WARC-Date"],
                heads["WARC-Payload-Digest"].removeprefix("sha256:"), int(re.search(rb"Content-Length: (\d+)", http)[1]),
                refers and refers[1:-1], _url(heads, "WARC-Refers-To-Target-URI"), heads.get("WARC-Refers-To-Date"),
            )
            out.append(row + (payload.decode("utf-8") if kind == "response" else None,) * with_payload)
            held += len(block) * with_payload + 300
            if held > 1 << 23:
                yield _frame(out, names)
                out, held = [], 0
        if out:
            yield _frame(out, names)

    rows = spark.read.option("lineSep", GAP).text(path)
    return rows.mapInPandas(records, RECORD + ", payload string" * with_payload)


def _frame(rows: list[tuple], names: list[str]) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=names).assign(page_id=pd.array([r[2] for r in rows], dtype="Int64"))


def resolve(records: DataFrame) -> DataFrame:
    """``page_id, url, payload_bytes, payload_digest, record_type, refers_to``: revisits joined to the page of their response.

    Null page ids stay null, also as ``refers_to``.
    """
    originals = records.where("record_type = 'response'").select(F.col("record_id").alias("refers_to_record"), F.col("page_id").alias("refers_to"))
    plain = records.where("record_type = 'response'").withColumn("refers_to", F.lit(None).cast("long"))
    # a response that very many revisits name is one row on its side
    back = records.where("record_type = 'revisit'").join(originals, "refers_to_record", "left")
    return plain.unionByName(back).select("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to")
