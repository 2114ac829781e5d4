"""HTTP text of captured packets, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# A payload is a request if it starts with one of the first seven verbs;
# the request line may then name any of the nine.
REQUEST_PREFIXES = ["GET", "POST", "PUT", "DELETE", "PATCH", "HEAD", "OPTIONS"]
REQUEST_LINE = (
    r"(?iU)^(GET|POST|PUT|DELETE|PATCH|HEAD|OPTIONS|CONNECT|TRACE)\s+(\S+)\s+HTTP/[\d.]+"
)

# The characters Unicode counts as white space.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def stripped(text: Column) -> Column:
    return F.btrim(text, F.lit(WHITE_SPACE))


def decode_payload(payload: Column) -> Column:
    """Bytes to text: UTF-8 where valid, else Latin-1 (which always decodes)."""
    text = payload.cast("string")
    return F.when(F.is_valid_utf8(text), text).otherwise(F.decode(payload, "ISO-8859-1"))


def _lines(text: Column) -> Column:
    return F.split(text, "\r\n")


def is_request(text: Column) -> Column:
    starts = F.lit(False)
    for verb in REQUEST_PREFIXES:
        starts = starts | text.startswith(verb)
    return F.coalesce(starts & _lines(text)[0].rlike(REQUEST_LINE), F.lit(False))


def request_method(text: Column) -> Column:
    return F.when(
        is_request(text), F.upper(F.regexp_extract(_lines(text)[0], REQUEST_LINE, 1))
    )


def request_path(text: Column) -> Column:
    """Path as sent, query string included."""
    return F.when(is_request(text), F.regexp_extract(_lines(text)[0], REQUEST_LINE, 2))


def header_lines(text: Column) -> Column:
    """Trimmed lines between the request line and the first blank line."""
    lines = _lines(text)
    rest = F.transform(F.slice(lines, 2, F.greatest(F.size(lines), F.lit(1))), stripped)
    blank = F.array_position(rest, "")
    return F.when(blank > 0, F.slice(rest, F.lit(1), (blank - 1).cast("int"))).otherwise(rest)


def header(lines: Column, name: str) -> Column:
    """Value of the last header called ``name`` in ``header_lines``, else NULL."""
    pattern = rf"(?idmU)\A{name}:\s*(.+)$"
    found = F.filter(lines, lambda line: line.rlike(pattern))
    return stripped(F.regexp_extract(F.try_element_at(found, F.lit(-1)), pattern, 1))


def body(text: Column) -> Column:
    """Text after the first blank line, trimmed; NULL if empty."""
    start = F.locate("\r\n\r\n", text)
    rest = stripped(F.substr(text, start + 4))
    return F.when((start > 0) & (rest != ""), rest)


def http_requests(packets: DataFrame) -> DataFrame:
    """Packets that carry a request line, parsed; all other packets are dropped."""
    text = F.col("_text")
    return (
        packets.where(F.col("payload").isNotNull())
        .withColumn("_text", decode_payload(F.col("payload")))
        .where(is_request(text))
        .withColumn("_headers", header_lines(text))
        .select(
            "trace_id",
            "pkt_no",
            "ts",
            request_method(text).alias("method"),
            request_path(text).alias("path"),
            F.coalesce(header(F.col("_headers"), "Host"), F.lit("")).alias("host"),
            header(F.col("_headers"), "User-Agent").alias("user_agent"),
            header(F.col("_headers"), "Content-Type").alias("content_type"),
            body(text).alias("body"),
        )
    )


def capture_name_parts(name: Column) -> Column:
    """``{ip}_{port}_{ip}_{port}.pcap`` as a struct; all NULL if it does not parse."""
    parts = F.split(F.replace(name, F.lit(".pcap"), F.lit("")), "_")
    ports = [F.get(parts, F.lit(i)).try_cast("int") for i in (1, 3)]
    good = (F.size(parts) >= 4) & ports[0].isNotNull() & ports[1].isNotNull()
    return F.struct(
        F.when(good, F.get(parts, F.lit(0))).alias("source_ip"),
        F.when(good, ports[0]).alias("source_port"),
        F.when(good, F.get(parts, F.lit(2))).alias("dest_ip"),
        F.when(good, ports[1]).alias("dest_port"),
    )


def service_name(path: Column) -> Column:
    """First non-empty segment of a path, else ``unknown``."""
    segments = F.filter(F.split(path, "/"), lambda s: s != "")
    return F.coalesce(F.try_element_at(segments, F.lit(1)), F.lit("unknown"))


def ip_type(ip: Column) -> Column:
    """``private_ip`` for loop-back and private ranges, else ``default``."""
    second = F.split_part(ip, F.lit("."), F.lit(2)).try_cast("int")
    private = (
        ip.startswith("127.")
        | ip.startswith("192.168.")
        | ip.startswith("10.")
        | (ip.startswith("172.") & F.coalesce(second.between(16, 31), F.lit(False)))
    )
    return F.when(private, "private_ip").otherwise("default")
