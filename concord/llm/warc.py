"""Content-addressed WARC archive: payload bytes once by strong digest, exact record headers apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from concord.llm.common import HOT_ROWS, fresh_path, join_groups

STORE = "strong string, payload binary, response_id long, copies long, copies_to_read int"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
CRLF = "\r\n"
#: Records of one payload that meet a copy of it when records are rebuilt; more records meet more copies.
RECORDS_PER_COPY = 10_000


def base32_sha1(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: 40 hex digits are eight groups of 20 bits, each four symbols."""
    digest = F.sha1(payload)
    symbols = []
    for g in range(8):
        bits = F.conv(F.substring(digest, 5 * g + 1, 5), 16, 10).cast("int")
        symbols += [F.substring(F.lit(BASE32), F.shiftright(bits, shift).bitwiseAND(31) + 1, F.lit(1)) for shift in (15, 10, 5, 0)]
    return F.concat(*symbols)


def payload_of(html: Column) -> Column:
    return F.coalesce(html.cast("string"), F.lit("")).cast("binary")


def write_archive(
    pages: DataFrame,
    path: str,
    id_col: str = "page_id",
    url_col: str = "url",
    html_col: str = "html",
    min_bytes: int = 0,
    date: str = "1970-01-01T00:00:00Z",
    hot_rows: int = HOT_ROWS,
    records_per_copy: int = RECORDS_PER_COPY,
) -> None:
    """Write ``path/store`` (payloads) and ``path/headers`` (one exact WARC record header per page).

    The store groups payloads by SHA-256 **and** bytes with map-side combine: copies collapse before the exchange, and
    two different payloads of one digest would show as two rows, which is an error. Records of at least ``min_bytes``
    with a payload seen at a smaller id are revisits of it, the others responses. CR and LF of a URL are percent-encoded.
    Records of a payload that over ``hot_rows`` pages have find it by a broadcast of its digest (``join_groups``). A header
    says which of the payload's ``copies_to_read`` it meets, one for ``records_per_copy`` records.

    Defined cases: null html is an empty payload, a null url an empty target; repeated rows of the responding id are all
    responses; a null id never is the response unless all of its copies have none. An empty table writes an empty archive.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"), payload_of(F.col(html_col)).alias("payload")).withColumn("strong", F.sha2("payload", 256))
    rows.groupBy("strong", "payload").agg(F.min("page_id").alias("response_id"), F.count("*").alias("copies")).withColumn("copies_to_read", F.ceil(F.col("copies") / records_per_copy).cast("int")).write.option("compression", "zstd").parquet(f"{path}/store")
    store = spark.read.schema(STORE).parquet(f"{path}/store")
    clash = store.groupBy("strong").count().where("count > 1").take(1)
    if clash:
        raise ValueError(f"two payloads share the SHA-256 {clash[0].strong}")

    n = F.octet_length("payload")
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("n"), F.lit(CRLF + CRLF))
    revisit = (F.col("n") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("response_id")) & F.col("response_id").isNotNull()
    body = F.length("http") + F.when(F.col("revisit"), F.lit(0)).otherwise(F.col("n"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    header = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        line("WARC-Type", F.when(F.col("revisit"), F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", urn(F.col("page_id"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(F.col("revisit"), F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("WARC-Refers-To", urn(F.col("response_id"))))).otherwise(F.lit("")),
        F.lit(f"Content-Type: application/http;msgtype=response{CRLF}"),
        line("Content-Length", body.cast("string")),
        F.lit(CRLF),
        F.col("http"),
    )
    slim = rows.select("page_id", "url", "strong", base32_sha1(F.col("payload")).alias("sha1"), n.alias("n"))
    found = join_groups(slim, store.select("strong", "response_id", "copies_to_read"), "strong", store.select("strong", "copies"), "copies", hot_rows)
    headed = found.withColumn("copy", F.pmod(F.xxhash64("page_id", "url"), F.col("copies_to_read")).cast("int")).withColumn("revisit", revisit).withColumn("http", http)
    headed.select("page_id", header.alias("header"), "strong", "copy").write.option("compression", "zstd").parquet(f"{path}/headers")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """``record`` (the exact bytes of each WARC record), ``payload`` (resolved through the store for revisits), ``head_bytes``.

    ``head_bytes`` is the length of the record's WARC and HTTP headers, which a URL of any length may fill.
    """
    store = spark.read.schema(STORE).parquet(f"{path}/store").select("strong", "payload", F.explode(F.sequence(F.lit(0), F.col("copies_to_read") - 1)).alias("copy"))
    headers = spark.read.schema("page_id long, header string, strong string, copy int").parquet(f"{path}/headers")
    is_revisit = F.col("header").startswith(f"WARC/1.1{CRLF}WARC-Type: revisit{CRLF}")
    own = F.when(is_revisit, F.lit(b"")).otherwise(F.col("payload"))
    return headers.join(store, ["strong", "copy"]).select(F.concat(F.col("header").cast("binary"), own, F.lit(b"\r\n\r\n")).alias("record"), "payload", F.octet_length("header").alias("head_bytes"))


def parse_records(records: DataFrame) -> DataFrame:
    """Digest columns of each record, from the bytes of the archive alone.

    The payload of a response is cut out of its record by the lengths that the headers give; that of a revisit is the
    referred one. The digest is computed anew and must equal the header's, else the row fails the query.
    """
    # header fields are ASCII but for the URI, so positions in the Latin-1 text are byte positions. Lines end with CRLF
    # alone, which no URI has: other line ends that Unicode knows may stand in a URI
    head = F.decode(F.substring("record", F.lit(1), F.col("head_bytes")), "ISO-8859-1")
    found = records.withColumn("warc", F.substring_index(head, CRLF + CRLF, 1)).withColumn("http", F.substring_index(F.substring_index(head, CRLF + CRLF, 2), CRLF + CRLF, -1))
    lines = F.split("warc", CRLF)
    field = lambda name: F.substr(F.get(F.filter(lines, lambda x: x.startswith(f"{name}: ")), F.lit(0)), F.lit(len(name) + 3))
    kind = field("WARC-Type")
    start = F.length("warc") + F.length("http") + 8
    size = field("Content-Length").cast("int") - F.length("http") - 4
    content = F.when(kind == "response", F.substring(F.col("record"), start + 1, size)).otherwise(F.col("payload"))
    page = lambda text: F.expr(f"try_cast(regexp_extract({text}, '<urn:page:([0-9-]+)>', 1) as bigint)")
    parsed = found.select(field("WARC-Record-ID").alias("rid"), kind.alias("record_type"), F.coalesce(field("WARC-Refers-To"), F.lit("")).alias("ref"), field("WARC-Payload-Digest").alias("claimed"), content.alias("content")).withColumn(
        "payload_digest", base32_sha1(F.col("content"))
    )
    checked = F.when(F.concat(F.lit("sha1:"), F.col("payload_digest")) == F.col("claimed"), F.col("payload_digest")).otherwise(F.raise_error(F.lit("payload digest differs from the record's header")))
    return parsed.select(page("rid").alias("page_id"), F.octet_length("content").cast("long").alias("payload_bytes"), checked.alias("payload_digest"), "record_type", page("ref").alias("refers_to"))


def round_trip(pages: DataFrame) -> DataFrame:
    """Write the archive of ``pages`` to the shared folder, read it back and parse every record."""
    path = fresh_path(pages.sparkSession, "warc")
    write_archive(pages, path)
    return parse_records(read_archive(pages.sparkSession, path))
