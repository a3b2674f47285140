"""WARC derivative builder: responses become linked metadata and plain-text conversion records (WARC 1.1)."""

from __future__ import annotations

import gzip
import html.entities
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from . import common as C

CRLF = "\r\n"
#: What stands for a character in HTML, behind an ampersand: by number, by hexadecimal number, or by name.
REFERENCE = r"(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,30});"
#: Name -> character: &apos; and the names of HTML 4, the commonest first. Other names stay as they are written.
ENTITIES = {"amp": "&", "quot": '"', "lt": "<", "gt": ">", "nbsp": "\u00a0", "apos": "'"} | {n: chr(c) for n, c in html.entities.name2codepoint.items()}


def record_uuid(*parts: Column) -> Column:
    """A stable urn:uuid from the md5 of the parts."""
    h = F.md5(F.concat_ws("|", *parts))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def sha1_digest(text: Column) -> Column:
    return F.concat(F.lit("sha1:"), F.sha1(text))


def decoded(text: Column, names: dict[str, str] = ENTITIES) -> Column:
    """text with its character references resolved, each once; numbers that are no character become U+FFFD."""
    known = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])

    def resolved(piece: Column) -> Column:
        """piece: what follows an ampersand, up to the next one."""
        body = F.substring_index(piece, ";", 1)
        number = F.when(body.startswith("#x") | body.startswith("#X"), F.conv(F.substring(body, 3, 8), 16, 10).cast("long")).when(body.startswith("#"), F.substring(body, 2, 8).cast("long"))
        good = (number > 0) & (number <= 0x10FFFF) & ~number.between(0xD800, 0xDFFF)
        char = F.when(body.startswith("#"), F.decode(F.unhex(F.lpad(F.hex(F.when(good, number).otherwise(0xFFFD)), 8, "0")), "UTF-32")).otherwise(F.try_element_at(known, body))
        put = F.concat(char, F.substr(piece, F.length(body) + 2))
        return F.when(piece.rlike("^" + REFERENCE), F.coalesce(put, F.concat(F.lit("&"), piece))).otherwise(F.concat(F.lit("&"), piece))

    def whole(t: Column) -> Column:
        pieces = F.split(t, "&", -1)
        return F.concat(pieces[0], F.array_join(F.transform(F.slice(pieces, 2, F.size(pieces)), resolved), ""))

    # text is a variable inside the lambda and so worked out once
    return F.transform(F.array(text), lambda t: F.when(F.contains(t, F.lit("&")), whole(t)).otherwise(t))[0]


def plain_text(page: Column) -> Column:
    """Text of an HTML payload: no scripts, styles, comments or tags; blocks on lines of their own; references resolved
    (a non-breaking space becomes a space)."""
    t = F.regexp_replace(page, r"(?is)<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<!--.*?-->", "")
    t = F.regexp_replace(t, r"(?i)<(?:/(?:p|div|li|h[1-6]|title|article|nav|tr|table|section)|br/?)>", "\n")
    t = F.translate(decoded(F.regexp_replace(t, r"<[^>]*>", "")), "\u00a0", " ")
    return F.regexp_replace(F.regexp_replace(t, r"[ \t\r]*\n[ \t\r\n]*", "\n"), r"^[ \n]+|[ \n]+$", "")


def named_fields(headers: Column) -> Column:
    """HTTP headers as lines of named fields: a line without a field name, such as the status line, is called source-line."""
    lines = F.filter(F.split(headers, "\r?\n", -1), lambda x: F.trim(x) != "")
    named = F.transform(lines, lambda x: F.when(x.rlike(r"^[!#$%&'*+.^_`|~0-9A-Za-z-]+:"), x).otherwise(F.concat(F.lit("source-line: "), F.trim(x))))
    return F.array_join(F.transform(named, lambda x: F.concat(x, F.lit(CRLF))), "")


def responses_from_pages(pages: DataFrame, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """pages (page_id, url, html) -> response records: page_id, record_id, target_uri, date, source_headers, payload.

    A table of pages has neither date nor headers: date is the caller's, the headers are the least that a response has.
    """
    own, of = C.by_position(pages)
    pages = own.select(*[F.col(C.column_of(of, c)).alias(c) for c in ("page_id", "url", "html")])
    body = F.coalesce(F.col("html"), F.lit(""))
    uri = F.coalesce(F.col("url"), F.lit(""))
    headers = F.concat(F.lit("HTTP/1.1 200 OK" + CRLF + "Content-Type: text/html; charset=utf-8" + CRLF + "Content-Length: "), F.octet_length(body).cast("string"), F.lit(CRLF))
    ident = record_uuid(F.lit("response"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), uri)
    return pages.select("page_id", ident.alias("record_id"), uri.alias("target_uri"), F.lit(date).alias("date"), headers.alias("source_headers"), body.alias("payload"))


def derivatives(responses: DataFrame) -> DataFrame:
    """responses (page_id, record_id, target_uri, date, source_headers, payload) -> two records for each row.

    metadata: the response's HTTP headers, payload digest and length as warc-fields, and the id of its conversion;
    conversion: the payload's plain text. Both refer to the response (refers_to), keep target URI and date, and
    carry the digest and length of their own block; payload_digest is the source payload's. Null payloads and headers count as
    empty and convert to an empty block; other null columns stay null; payloads of any length are converted whole;
    repeated rows give repeated records; an empty table gives none; extra columns are ignored, whatever their names.
    """
    own, of = C.by_position(responses)
    responses = own.select(*[F.col(C.column_of(of, c)).alias(c) for c in ("page_id", "record_id", "target_uri", "date", "source_headers", "payload")])
    payload = F.coalesce(F.col("payload"), F.lit(""))
    base = responses.select("page_id", F.col("record_id").alias("refers_to"), "target_uri", "date", named_fields(F.coalesce("source_headers", F.lit(""))).alias("source_headers"), sha1_digest(payload).alias("payload_digest"), F.octet_length(payload).alias("payload_bytes"), plain_text(payload).alias("plain"))
    base = base.withColumn("conversion_id", record_uuid(F.lit("conversion"), F.col("refers_to")))
    fields = F.concat(
        F.lit("payload-digest: "), "payload_digest", F.lit(CRLF + "payload-length: "), F.col("payload_bytes").cast("string"),
        F.lit(CRLF + "has-conversion: "), "conversion_id", F.lit(CRLF), F.col("source_headers"),
    )
    meta = F.struct(F.lit("metadata").alias("record_type"), record_uuid(F.lit("metadata"), F.col("refers_to")).alias("record_id"), F.lit("application/warc-fields").alias("content_type"), fields.alias("block"))
    conv = F.struct(F.lit("conversion").alias("record_type"), F.col("conversion_id").alias("record_id"), F.lit("text/plain").alias("content_type"), F.col("plain").alias("block"))
    out = base.select("page_id", "refers_to", "target_uri", "date", "payload_digest", F.inline(F.array(meta, conv)))
    return out.withColumn("block_digest", sha1_digest(F.col("block"))).withColumn("content_length", F.octet_length("block").cast("long"))


def record_text(records: DataFrame) -> DataFrame:
    """One column, value: the WARC record of each row of derivatives(), with the two line breaks at its end. A field whose
    value is null is left out."""
    head = F.concat_ws(
        CRLF, F.lit("WARC/1.1"), *[F.concat(F.lit(name + ": "), F.col(c).cast("string")) for name, c in (
            ("WARC-Type", "record_type"), ("WARC-Record-ID", "record_id"), ("WARC-Refers-To", "refers_to"), ("WARC-Target-URI", "target_uri"), ("WARC-Date", "date"),
            ("WARC-Payload-Digest", "payload_digest"), ("WARC-Block-Digest", "block_digest"), ("Content-Type", "content_type"), ("Content-Length", "content_length"))],
    )
    return records.select(F.concat(head, F.lit(CRLF + CRLF), F.col("block"), F.lit(CRLF + CRLF)).alias("value"))


@dataclass
class _Written(WriterCommitMessage):
    name: str


class _WarcWriter(DataSourceWriter):
    """A file for each partition, written under another name and renamed when all are complete."""

    def __init__(self, uri: str):
        self.uri = uri.rstrip("/")

    def _at(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.uri) if "://" in self.uri else (fs.LocalFileSystem(), self.uri)

    def write(self, rows: Iterator) -> _Written:
        import uuid

        from pyspark import TaskContext

        system, folder = self._at()
        system.create_dir(folder, recursive=True)
        name = f"part-{TaskContext.get().partitionId():05d}-{uuid.uuid4().hex}.warc.gz"
        with system.open_output_stream(f"{folder}/_{name}", compression=None) as out:
            for row in rows:
                out.write(gzip.compress(row[0].encode(), mtime=0))
        return _Written(name)

    def commit(self, messages: list) -> None:
        system, folder = self._at()
        for m in messages:
            system.move(f"{folder}/_{m.name}", f"{folder}/{m.name}")

    def abort(self, messages: list) -> None:
        system, folder = self._at()
        for m in messages:
            if m is not None:
                system.delete_file(f"{folder}/_{m.name}")


class WarcSink(DataSource):
    """df.write.format("warc").mode("append").save(path): one gzip member for each value of the only column."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def writer(self, schema, overwrite: bool) -> _WarcWriter:
        return _WarcWriter(self.options["path"])


def write_warc(records: DataFrame, path: str) -> None:
    """Files of gzipped records under path, one for each partition and one gzip member for each record, so that a reader can
    start at any of them. path: of a file system that pyarrow knows (a shared folder, hdfs://, s3://, gs://)."""
    C.prepare(records.sparkSession)
    records.sparkSession.dataSource.register(WarcSink)
    record_text(records).write.format("warc").mode("append").save(path)
