"""WARC derivatives: linked metadata and plain-text conversion records from response records.

Each response gives a metadata record (source headers, title, language, link count) and a conversion record (visible text).
Both refer to the response by WARC-Refers-To, carry its target URI and date and the digest of its payload, and the
metadata record names the conversion record and repeats the response's own HTTP headers. read_responses() takes responses from WARC
files as they were captured; responses() makes them of a table of pages, with the headers and dates of its columns where it has
them. Record ids are derived from the response's id, so a rerun gives the same ones; the id of a page's response covers its
payload, so two captures of one URL differ. Extraction is a chain of regular expressions in the plan, each linear in the page's
length: tags end at the next "<" at the latest, and comments, scripts, styles and titles that are never closed run to the end.
write_warc() serialises records into gzip members.

Defined cases: a null page is an empty payload; a null URL an empty target; repeated responses give repeated records with the
same ids; an empty table gives no records; other columns are ignored. Records of other types in a WARC file are skipped; a
response without a WARC-Record-ID gets one from its target, date and payload. Captured bodies lose their transfer and content codings (chunked; gzip,
deflate, zstd) before their text is read, as far as a cut-off body goes; other content codings, for which there is no decoder here, leave an empty payload.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import re
import uuid
import zlib
from collections.abc import Iterator
from html import entities

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import python_workers

#: The date of records whose source has none.
DATE = "2024-01-31T00:00:00Z"
BLOCK_TAGS = "address|article|aside|blockquote|body|br|dd|div|dl|dt|fieldset|figure|footer|form|h1|h2|h3|h4|h5|h6|head|header|hr|html|li|main|nav|ol|option|p|pre|section|table|tbody|td|th|title|tr|ul"
TITLE = r"(?is)<title(?:\s[^<>]*)?>(.*?)(?:</title\s*>|\z)"
LANGUAGE = r'(?i)<html[^<>]*\slang="?([A-Za-z-]*)'
LINK = r"(?i)<a\s[^<>]*href="
#: (pattern, replacement), in order; the patterns mean the same in Java and RE2. None: character references are decoded here.
TEXT_RULES = [
    (r"(?s)<!--.*?(?:-->|\z)", " "),
    (r"(?is)<script(?:\s[^>]*)?(?:>|\z).*?(?:</script\s*>|\z)", " "),
    (r"(?is)<style(?:\s[^>]*)?(?:>|\z).*?(?:</style\s*>|\z)", " "),
    (rf"(?i)</?(?:{BLOCK_TAGS})(?:\s[^<>]*)?/?>", "\n"),
    (r"<[^<>]*>", ""),
    (None, None),
    (r"[ \t\r\f]+", " "),
    (r" ?\n[ \n]*", "\n"),
    (r"^[ \n]+", ""),
    (r"[ \n]+$", ""),
]


#: Names that stand without a semicolon too, longest first.
_BARE = "|".join(sorted((n for n in entities.html5 if not n.endswith(";")), key=len, reverse=True))
#: What the numbers 128 to 159 mean: Windows-1252, where it has a character.
_C1 = {n: bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(128, 160)}
#: Control characters and noncharacters, which numeric references cannot name.
_NO_CHARACTER = [*range(1, 9), 11, *range(14, 32), 127, *range(0xFDD0, 0xFDF0), *(p << 16 | x for p in range(17) for x in (0xFFFE, 0xFFFF))]


def _table(pairs: dict) -> Column:
    """A constant map of strings; none of them holds the separators."""
    return F.str_to_map(F.lit("\x01".join(f"{k}\x02{v}" for k, v in pairs.items())), F.lit("\x01"), F.lit("\x02"))


def _numbered(digits: Column, base: int) -> Column:
    """The character of a numeric reference, by the rules of HTML."""
    short = F.regexp_replace(digits, "^0+", "")
    n = F.when(F.length(short) > 7, F.lit(0x110000)).otherwise(F.conv(short, base, 10).try_cast("long"))
    n = F.coalesce(n, F.lit(0))
    lost = (n == 0) | n.between(0xD800, 0xDFFF) | (n > 0x10FFFF)
    char = F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")
    return F.when(lost, "\ufffd").when(n == 160, " ").when(n.between(128, 159), F.get(F.array(*[F.lit(_C1[k]) for k in range(128, 160)]), (n - 128).cast("int"))).when(n.isin(_NO_CHARACTER), "").otherwise(char)


def decode_references(text: Column) -> Column:
    """text with every named and numeric character reference decoded once, as html.unescape does; a no-break space becomes a space."""
    named = _table({k: v.replace("\xa0", " ") for k, v in entities.html5.items()})

    def piece(p: Column) -> Column:
        dec, hexa = F.regexp_extract(p, r"^#([0-9]+);?", 1), F.regexp_extract(p, r"^#[xX]([0-9a-fA-F]+);?", 1)
        full, bare = F.regexp_extract(p, r"^[A-Za-z][A-Za-z0-9]*;", 0), F.regexp_extract(p, f"^(?:{_BARE})", 0)
        rest = lambda ref: F.substr(p, F.length(ref) + 1)
        value = F.try_element_at(named, full)
        return (
            F.when(dec != "", F.concat(_numbered(dec, 10), rest(F.regexp_extract(p, r"^#[0-9]+;?", 0))))
            .when(hexa != "", F.concat(_numbered(hexa, 16), rest(F.regexp_extract(p, r"^#[xX][0-9a-fA-F]+;?", 0))))
            .when((full != "") & value.isNotNull(), F.concat(value, rest(full)))
            .when(bare != "", F.concat(F.try_element_at(named, bare), rest(bare)))
            .otherwise(F.concat(F.lit("&"), p))
        )

    return F.array_join(F.transform(F.split(text, "&"), lambda p, i: F.when(i == 0, p).otherwise(piece(p))), "")


def visible_text(html: Column) -> Column:
    text = F.coalesce(html, F.lit(""))
    for pattern, put in TEXT_RULES:
        text = F.regexp_replace(text, pattern, put) if pattern else decode_references(text)
    return text


def _record_id(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *parts).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), *[x for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)) for x in ((F.lit("-"),) if a > 1 else ()) + (F.substring(h, a, n),)], F.lit(">"))


def _digest(block: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(block.cast("binary"), 256))


def responses(pages: DataFrame, headers_col: str | None = None, date_col: str | None = None) -> DataFrame:
    """Pages as response records: page_id, response_id, target_uri, warc_date, http_headers, payload, payload_digest.

    headers_col: the captured status line and headers; without it (or where it is null) they are those of a plain answer.
    """
    payload = F.coalesce(F.col("html"), F.lit(""))
    uri = F.coalesce(F.col("url"), F.lit(""))
    plain = F.concat(F.lit("HTTP/1.1 200 OK\nContent-Type: text/html; charset=utf-8\nContent-Length: "), F.octet_length(payload).cast("string"))
    headers = F.coalesce(F.col(headers_col), plain) if headers_col else plain
    date = F.coalesce(F.col(date_col).cast("string"), F.lit(DATE)) if date_col else F.lit(DATE)
    own = _record_id(F.lit("response"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), uri, _digest(payload))
    return pages.select("page_id", own.alias("response_id"), uri.alias("target_uri"), date.alias("warc_date"), headers.alias("http_headers"), payload.alias("payload"), _digest(payload).alias("payload_digest"))


RAW = "page_id string, response_id string, target_uri string, warc_date string, http_headers string, payload string, payload_digest string"


def _records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an uncompressed WARC stream, one after the other."""
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            continue  # the empty lines between records
        head: dict[str, str] = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            head[name.strip().lower()] = value.strip()
        size = head.get("content-length", "0")
        yield head, stream.read(int(size) if size.isdigit() else 0)


TRANSFER_CHUNKED = re.compile(r"(?im)^transfer-encoding:.*\bchunked\b")
CHUNK = re.compile(rb"([0-9A-Fa-f]+)[^\r\n]*\r?\n")
CONTENT_CODING = re.compile(r"(?im)^content-encoding:(.*)$")


def unchunk(body: bytes) -> bytes:
    """A body sent in chunks as one; unchanged where it isn't one (captures may hold it joined), and up to where a cut-off one goes."""
    out, at = [], 0
    while line := CHUNK.match(body, at):
        size, at = int(line[1], 16), line.end()
        if not size:
            return b"".join(out)
        out.append(body[at : at + size])
        at += size
        at += 2 if body[at : at + 2] == b"\r\n" else body[at : at + 1] == b"\n"
    return b"".join(out) if out else body


def decompress(body: bytes, coding: str) -> bytes:
    """A body without its content coding, as far as it goes if cut off; unchanged where it isn't so coded. Other codings than gzip, deflate and zstd give an empty one."""
    if coding in ("", "identity"):
        return body
    if coding in ("gzip", "x-gzip"):
        out = []
        while body.startswith(b"\x1f\x8b"):
            text, body = _inflated(body, 31)
            out.append(text)
        return b"".join(out) if out else body
    if coding == "deflate":  # with a header or without one, both are in use
        return _inflated(body, 15)[0] or _inflated(body, -15)[0] or body
    if coding == "zstd":
        return zstandard.ZstdDecompressor().decompressobj().decompress(body) if body.startswith(b"\x28\xb5\x2f\xfd") else body
    return b""


def _inflated(body: bytes, window: int) -> tuple[bytes, bytes]:
    """What one compressed stream holds up to its end or first error, and what stands behind it."""
    member, out, step = zlib.decompressobj(window), [], 1 << 16
    for k in range(0, len(body), step):
        try:
            out.append(member.decompress(body[k : k + step]))
        except zlib.error:
            return b"".join(out), b""
        if member.eof:
            return b"".join(out), member.unused_data + body[k + step :]
    return b"".join(out), b""


def _response_row(head: dict[str, str], block: bytes, name: str) -> tuple | None:
    if head.get("warc-type", "").lower() != "response":
        return None
    top, _, body = block.partition(b"\r\n\r\n") if block.startswith(b"HTTP/") else (b"", b"", block)
    fields = top.decode("latin-1").replace("\r\n", "\n")
    if TRANSFER_CHUNKED.search(fields):
        body = unchunk(body)
    digest = head.get("warc-payload-digest") or "sha256:" + hashlib.sha256(body).hexdigest()
    for coding in reversed([c.strip().lower() for line in CONTENT_CODING.findall(fields) for c in line.split(",")]):
        body = decompress(body, coding)
    charset = re.search(r"(?im)^content-type:.*charset=\"?([A-Za-z0-9_-]+)", fields)
    try:
        text = body.decode(charset[1] if charset else "utf-8", "replace")
    except LookupError:
        text = body.decode("utf-8", "replace")
    uri, date = head.get("warc-target-uri", "").strip("<>"), head.get("warc-date", DATE)
    own = head.get("warc-record-id") or f"<urn:uuid:{uuid.UUID(hashlib.md5('|'.join((uri, date, digest)).encode()).hexdigest())}>"
    return name, own, uri, date, fields, text, digest


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """The response records of WARC files (gzip members or plain): page_id (the file), then as in responses(), headers as captured.

    A task streams its files record by record, so a file need not fit in memory; the payload digest is the record's own where it has one.
    """
    python_workers(spark)
    files = spark.read.format("binaryFile").load(path).select("path")  # lists the files, reads none

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        names = [f.split(" ")[0] for f in RAW.split(", ")]
        for batch in batches:
            for name in batch.column("path").to_pylist():
                store, inner = fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", name))
                with store.open_input_stream(inner, compression=None) as raw:
                    stream = gzip.GzipFile(fileobj=raw) if inner.endswith(".gz") else raw
                    rows, held = [], 0
                    for head, block in _records(io.BufferedReader(stream)):
                        if row := _response_row(head, block, name):
                            rows.append(row)
                            held += len(block)
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], names=names)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows, strict=True)], names=names)

    return files.mapInArrow(run, RAW)


def derive(records: DataFrame) -> DataFrame:
    """Two rows for each response: page_id, warc_type, record_id, refers_to, target_uri, warc_date, content_type, content_length, block_digest, source_digest, block."""
    ids = records.withColumns({"metadata_id": _record_id(F.lit("metadata"), F.col("response_id")), "conversion_id": _record_id(F.lit("conversion"), F.col("response_id"))})
    title = visible_text(F.regexp_extract("payload", TITLE, 1))
    language = F.regexp_extract("payload", LANGUAGE, 1)
    links = F.regexp_count("payload", F.lit(LINK))
    fields = F.concat(
        F.regexp_replace("http_headers", r"(?m)^", "source-header: "), F.lit("\nsource-payload-digest: "), F.col("payload_digest"), F.lit("\nconversion-record: "), F.col("conversion_id"),
        F.lit("\ntitle: "), F.regexp_replace(title, "\n", " "), F.lit("\nlanguage: "), language, F.lit("\nlinks: "), links.cast("string"), F.lit("\n"),
    )
    kinds = F.array(
        F.struct(F.lit("metadata").alias("warc_type"), F.col("metadata_id").alias("record_id"), F.lit("application/warc-fields").alias("content_type"), fields.alias("block")),
        F.struct(F.lit("conversion").alias("warc_type"), F.col("conversion_id").alias("record_id"), F.lit("text/plain; charset=utf-8").alias("content_type"), visible_text(F.col("payload")).alias("block")),
    )
    rows = ids.select("page_id", F.col("response_id").alias("refers_to"), "target_uri", "warc_date", F.col("payload_digest").alias("source_digest"), F.inline(kinds))
    return rows.select("page_id", "warc_type", "record_id", "refers_to", "target_uri", "warc_date", "content_type", F.octet_length("block").cast("long").alias("content_length"), _digest(F.col("block")).alias("block_digest"), "source_digest", "block")


def to_bytes(row: dict) -> bytes:
    """One WARC/1.1 record."""
    body = row["block"].encode()
    head = {
        "WARC-Type": row["warc_type"], "WARC-Record-ID": row["record_id"], "WARC-Refers-To": row["refers_to"], "WARC-Target-URI": row["target_uri"], "WARC-Date": row["warc_date"],
        "WARC-Block-Digest": row["block_digest"], "WARC-Source-Payload-Digest": row["source_digest"], "Content-Type": row["content_type"], "Content-Length": str(len(body)),
    }
    clean = lambda x: x.replace("\r", " ").replace("\n", " ")
    return b"WARC/1.1\r\n" + "".join(f"{k}: {clean(v)}\r\n" for k, v in head.items()).encode() + b"\r\n" + body + b"\r\n\r\n"


def write_warc(records: DataFrame, out_dir: str) -> DataFrame:
    """Write each partition's records to a file of gzip members under out_dir (a URI) when read: path, record_id, member_offset, member_length."""
    python_workers(records.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs
        from pyspark import TaskContext

        store, base = fs.FileSystem.from_uri(out_dir)
        store.create_dir(base, recursive=True)
        name = f"derived-{TaskContext.get().partitionId():06d}.warc.gz"
        temporary, at = f"{base}/.{name}-{uuid.uuid4().hex}", 0
        with store.open_output_stream(temporary, compression=None) as file:
            for batch in batches:
                places = []
                for row in batch.to_pylist():
                    member = gzip.compress(to_bytes(row), mtime=0)
                    file.write(member)
                    places.append((f"{out_dir}/{name}", row["record_id"], at, len(member)))
                    at += len(member)
                columns = list(zip(*places, strict=True)) or [(), (), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.int64())], names=["path", "record_id", "member_offset", "member_length"])
        store.move(temporary, f"{base}/{name}")

    return records.mapInArrow(run, "path string, record_id string, member_offset long, member_length long")


def op7(spark, sf_dir: str) -> DataFrame:
    return derive(responses(spark.read.parquet(f"{sf_dir}/pages.parquet")))


def _quoted(s: str) -> str:
    return " || chr(10) || ".join("'" + part.replace("'", "''") + "'" for part in s.split("\n"))


def _sql_references(expression: str) -> str:
    """decode_references() in DuckDB, by the same rules; m is the map of named references."""
    n = "coalesce(CASE WHEN length(ltrim(d, '0')) > 7 THEN 1114112 ELSE try_cast(CASE WHEN ltrim(d, '0') = '' THEN '0' WHEN hexa THEN '0x' || ltrim(d, '0') ELSE ltrim(d, '0') END AS BIGINT) END, 0)"
    char = f"""CASE WHEN n = 0 OR n BETWEEN 55296 AND 57343 OR n > 1114111 THEN chr(65533) WHEN n = 160 THEN ' '
      WHEN n BETWEEN 128 AND 159 THEN [{", ".join(_quoted(_C1[k]) if _C1[k].isprintable() else f"chr({k})" for k in range(128, 160))}][n - 127]
      WHEN list_contains({_NO_CHARACTER}, n) THEN '' ELSE chr(CAST(n AS INTEGER)) END"""
    numbered = lambda p, hexa: f"list_transform(list_transform([regexp_extract({p}, '^#{'[xX]' if hexa else ''}([0-9{'a-fA-F' if hexa else ''}]+)', 1)] , lambda d: {n.replace('hexa', 'true' if hexa else 'false')}), lambda n: {char})[1]"
    piece = f"""CASE WHEN regexp_matches(p, '^#[0-9]+') THEN {numbered("p", False)} || regexp_replace(p, '^#[0-9]+;?', '')
      WHEN regexp_matches(p, '^#[xX][0-9a-fA-F]+') THEN {numbered("p", True)} || regexp_replace(p, '^#[xX][0-9a-fA-F]+;?', '')
      WHEN map_contains(m, regexp_extract(p, '^[A-Za-z][A-Za-z0-9]*;')) THEN m[regexp_extract(p, '^[A-Za-z][A-Za-z0-9]*;')] || regexp_replace(p, '^[A-Za-z][A-Za-z0-9]*;', '')
      WHEN regexp_matches(p, '^(?:{_BARE})') THEN m[regexp_extract(p, '^(?:{_BARE})')] || regexp_replace(p, '^(?:{_BARE})', '')
      ELSE '&' || p END"""
    return f"array_to_string(list_transform(string_split({expression}, '&'), lambda p, i: CASE WHEN i = 1 THEN p ELSE {piece} END), '')"


def _sql_text(expression: str) -> str:
    for pattern, put in TEXT_RULES:
        expression = f"regexp_replace({expression}, {_quoted(pattern)}, {_quoted(put)}, 'g')" if pattern else _sql_references(f"coalesce({expression}, '')")
    return expression


#: The named references as a DuckDB map.
_SQL_NAMED = "named AS (SELECT map_from_entries([" + ", ".join(f"({_quoted(k)}, {_quoted(v.replace(chr(160), ' '))})" for k, v in entities.html5.items()) + "]) AS m)"

def _sql_id(kind: str, rest: str) -> str:
    h = f"md5(concat_ws('|', '{kind}', {rest}))"
    return "concat('<urn:uuid:', " + ", '-', ".join(f"substr({h}, {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))) + ", '>')"


OP7_SQL = rf"""
WITH {_SQL_NAMED}, p AS (
  SELECT page_id, coalesce(html, '') AS payload, coalesce(url, '') AS target_uri,
         {_sql_id("response", "coalesce(CAST(page_id AS VARCHAR), ''), coalesce(url, ''), concat('sha256:', sha256(coalesce(html, '')))")} AS refers_to
  FROM pages
), r AS (
  SELECT *, concat('sha256:', sha256(payload)) AS source_digest,
         {_sql_id("metadata", "refers_to")} AS metadata_id, {_sql_id("conversion", "refers_to")} AS conversion_id,
         regexp_extract(payload, '{TITLE}', 1) AS title
  FROM p
), b AS (
  SELECT page_id, refers_to, target_uri, source_digest, 'metadata' AS warc_type, metadata_id AS record_id,
         'application/warc-fields' AS content_type,
         concat('source-header: HTTP/1.1 200 OK', chr(10), 'source-header: Content-Type: text/html; charset=utf-8', chr(10),
                'source-header: Content-Length: ', strlen(payload), chr(10), 'source-payload-digest: ', source_digest, chr(10),
                'conversion-record: ', conversion_id, chr(10), 'title: ', replace({_sql_text("title")}, chr(10), ' '), chr(10),
                'language: ', regexp_extract(payload, '{LANGUAGE}', 1), chr(10),
                'links: ', len(regexp_extract_all(payload, '{LINK}')), chr(10)) AS block
  FROM r, named
  UNION ALL
  SELECT page_id, refers_to, target_uri, source_digest, 'conversion', conversion_id, 'text/plain; charset=utf-8', {_sql_text("payload")} FROM r, named
)
SELECT page_id, warc_type, record_id, refers_to, target_uri, '{DATE}' AS warc_date, content_type,
       CAST(strlen(block) AS BIGINT) AS content_length, concat('sha256:', sha256(block)) AS block_digest, source_digest, block
FROM b
"""
