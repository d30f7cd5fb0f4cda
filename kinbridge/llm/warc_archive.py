"""Content-addressed WARC archive: payloads once, headers exactly, records by join.

``write`` stores two tables: ``payloads`` (strong digest, bytes), each distinct payload once, and
``headers`` (record id, place, exact header bytes, the payload's digest).  The least record id of equal
payloads of ``least`` bytes or more is the response, the others revisit it.  ``read`` joins them back to
whole records, verifies each payload against its strong digest, and parses the record's own headers.

A null payload is empty; null ids come last and are written as empty strings; rows that repeat an id and
a payload make equal records; header values have line breaks replaced by spaces; empty tables give
empty archives; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
END = "\r\n"


def base32_sha1(data: Column) -> Column:
    """Upper-case base32 of SHA-1: five hex digits at a time make four characters."""
    digits = F.sha1(data)
    out = []
    for i in range(8):
        n = F.conv(F.substring(digits, 5 * i + 1, 5), 16, 10).cast("int")
        out += [F.substring(F.lit(ALPHABET), F.shiftright(n, s).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*out)


def _line(name: str, value: Column) -> Column:
    return F.concat(F.lit(f"{name}: "), F.coalesce(F.regexp_replace(value.cast("string"), r"[\r\n]+", " "), F.lit("")), F.lit(END))


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", date: str = "1970-01-01T00:00:00Z", least: int = 0) -> None:
    """Write the archive's payloads and headers below path."""
    body = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    keyed = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), body.alias("payload")).withColumn("strong", F.sha2("payload", 256))
    # each payload once: copies are combined in every task before the shuffle
    keyed.groupBy("strong").agg(F.first("payload").alias("payload")).write.option("compression", "zstd").parquet(f"{path}/payloads")
    light = keyed.select("id", "url", "strong", F.length("payload").cast("long").alias("size"), base32_sha1(F.col("payload")).alias("digest"))
    light.write.option("compression", "zstd").parquet(f"{path}/light")
    light = pages.sparkSession.read.schema(light.schema).parquet(f"{path}/light")
    # the least id of each payload answers for it
    first = light.groupBy("strong").agg(F.min(F.struct(F.col("id").isNull().alias("unknown"), F.col("id").alias("id"))).alias("f")).select("strong", F.col("f.id").alias("first_id"))
    joined = light.join(first, "strong")
    own = F.col("id").eqNullSafe(F.col("first_id"))
    is_response = own | (F.col("size") < least)
    record_type = F.when(is_response, F.lit("response")).otherwise(F.lit("revisit"))
    uri = lambda c: F.concat(F.lit("<urn:record:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    refers = F.when(is_response, F.lit("")).otherwise(F.concat(_line("WARC-Refers-To", uri(F.col("first_id"))), _line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))))
    header = F.concat(
        F.lit(f"WARC/1.1{END}"), _line("WARC-Type", record_type), _line("WARC-Record-ID", uri(F.col("id"))), _line("WARC-Date", F.lit(date)), _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))), refers, _line("Content-Type", F.lit("text/html; charset=utf-8")), _line("Content-Length", F.when(is_response, F.col("size")).otherwise(F.lit(0))), F.lit(END),
    )
    joined.select("id", F.encode(header, "UTF-8").alias("header"), "strong").write.option("compression", "zstd").parquet(f"{path}/headers")


def field(header: Column, name: str) -> Column:
    """The value of a header field, or null."""
    value = F.regexp_extract(header, rf"\r\n{name}: ([^\r]*)\r\n", 1)
    return F.when(header.contains(f"{END}{name}: "), value)


def read(spark: SparkSession, path: str, payload_of_revisits: bool = True) -> DataFrame:
    """Records: id, header, payload (a revisit's is its response's), its size and digest, and the record's exact bytes.

    Each payload is verified once, before the records that share it are joined to it.
    """
    headers, payloads = spark.read.parquet(f"{path}/headers"), spark.read.parquet(f"{path}/payloads")
    verified = F.when(F.sha2("payload", 256) == F.col("strong"), F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("damaged payload "), F.col("strong"))))
    sound = payloads.select("strong", verified.alias("payload")).withColumns({"payload_bytes": F.length("payload").cast("long"), "payload_digest": base32_sha1(F.col("payload"))})
    out = headers.join(sound, "strong").select("id", F.decode("header", "UTF-8").alias("header"), "payload", "payload_bytes", "payload_digest")
    stored = F.when(field(F.col("header"), "WARC-Type") == "response", F.col("payload")).otherwise(F.lit(b""))
    out = out.withColumn("record", F.concat(F.encode("header", "UTF-8"), stored, F.lit(b"\r\n\r\n")))
    return out if payload_of_revisits else out.withColumn("payload", stored)
