"""Packet capture files, read in slices of bytes by many tasks, or whole through Spark's reader.

A capture has no marks between its packets, so a slice looks for its first packet by a chain of
plausible headers. Whether it found the right one is known for certain afterwards: the packets
of the slice before must end where it began. A file in which they do not is read by one task.
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..operators.lineage import checkpointed
from ..schemas import PACKETS

PACKETS_PER_BATCH = 5000
SLICE_BYTES = 64 << 20
BLOCK_BYTES = 8 << 20  # of a slice held at a time
LEAST_SNAP, CHAIN = 262_144, 6  # largest packet if the file names none; headers that must agree

# The four magic numbers of the classic format, as (byte order, ticks/second).
_MAGIC = {
    b"\xd4\xc3\xb2\xa1": ("<", 1e6),
    b"\xa1\xb2\xc3\xd4": (">", 1e6),
    b"\x4d\x3c\xb2\xa1": ("<", 1e9),
    b"\xa1\xb2\x3c\x4d": (">", 1e9),
}
_ARROW = pa.schema([
    ("trace_id", pa.string()), ("file_name", pa.string()), ("pkt_no", pa.int64()),
    ("ts", pa.float64()), ("src_ip", pa.string()), ("dst_ip", pa.string()),
    ("src_port", pa.int32()), ("dst_port", pa.int32()), ("payload", pa.binary()),
    ("error", pa.string()),
])


def scan_captures(
    spark: SparkSession, folder: str, label: str | DataFrame | None = None
) -> DataFrame:
    """All ``*.pcap`` directly in a folder, with ``trace_id``, ``file_name`` and ``label``.

    ``label`` is one label for all files or a table (file_name, label).
    """
    files = (
        spark.read.format("binaryFile").option("pathGlobFilter", "*.pcap")
        .option("recursiveFileLookup", False).load(folder)
        .select(
            F.md5("path").alias("trace_id"),
            F.element_at(F.split("path", "/"), -1).alias("file_name"),
            "content",
        )
    )
    if isinstance(label, DataFrame):
        return files.join(label.select("file_name", "label"), "file_name", "left")
    return files.withColumn("label", F.lit(label).cast("string"))


class _Format:
    """What the first 24 bytes of a capture say; raises ValueError if it is none."""

    def __init__(self, head: bytes):
        if head[:4] not in _MAGIC:
            raise ValueError("not a capture file")
        self.order, self.ticks = _MAGIC[head[:4]]
        if len(head) < 24 or struct.unpack(self.order + "I", head[20:24])[0] != 1:
            raise ValueError("not an Ethernet capture")
        named = struct.unpack(self.order + "I", head[16:20])[0]
        self.snap = max(named, LEAST_SNAP) if named < 1 << 28 else LEAST_SNAP
        self.header = struct.Struct(self.order + "IIII")
        self.size = struct.Struct(self.order + "I")

    def chain(self, data: bytes, at: int, stop: int) -> tuple[list[int], int]:
        """Places of the whole packets in ``data`` from ``at`` on that begin before ``stop``,
        and the place after them; that of a packet that ``data`` cuts off is beyond its end."""
        out, unpack, last = [], self.size.unpack_from, len(data)
        while at < stop and at + 16 <= last:
            end = at + 16 + unpack(data, at + 8)[0]
            if end > last:
                return out, end
            out.append(at)
            at = end
        return out, at if at + 16 <= last or at >= stop else max(at, last)

    def first(self, data: bytes, near: int) -> int | None:
        """The first place in ``data`` from which a chain of plausible headers goes on.

        ``near``: seconds of the file's first packet; a capture spans less than a year or two.
        """
        a = np.frombuffer(data, np.uint8).astype(np.uint32)
        if len(a) < 16:
            return None
        shifts = (0, 8, 16, 24) if self.order == "<" else (24, 16, 8, 0)
        word = sum(a[k : len(a) - 3 + k] << np.uint32(s) for k, s in enumerate(shifts))
        n = len(word) - 12
        sec, sub, size, whole = (word[k : n + k] for k in (0, 4, 8, 12))
        likely = (sub < self.ticks) & (size <= whole) & (size <= self.snap) & (size > 0) & (
            np.abs(sec.astype(np.int64) - near) < 2 * 366 * 86_400)
        for at in np.flatnonzero(likely).tolist():
            places, upto, good = 0, at, True
            while good and places < CHAIN and upto < n:
                good = bool(likely[upto])
                places, upto = places + 1, upto + 16 + int(size[upto]) if good else upto
            if good:
                return at
        return None


def _bytes_at(a: np.ndarray, at: np.ndarray, there: np.ndarray) -> np.ndarray:
    return a[np.where(there, at, 0)].astype(np.int64)


def _address(a: np.ndarray, at: np.ndarray, there: np.ndarray) -> pa.Array:
    """Dotted addresses of four bytes each, NULL where ``there`` is false."""
    whole = sum(_bytes_at(a, at + k, there) << (24 - 8 * k) for k in range(4))
    known, place = np.unique(whole, return_inverse=True)
    texts = pa.array([".".join(str(x >> s & 255) for s in (24, 16, 8, 0)) for x in known.tolist()], pa.string())
    return texts.take(pa.array(place, mask=~there))


def _decoded(
    data: bytes, places: list[int], form: _Format, trace: str, name: str, number: int
) -> pa.RecordBatch:
    """Packet rows of the packets at ``places``: addresses, ports and payload of Ethernet frames
    with IPv4 and TCP, NULLs for others."""
    a = np.frombuffer(data, np.uint8)
    heads = np.array([form.header.unpack_from(data, at)[:3] for at in places], np.int64).reshape(-1, 3)
    at, size = np.array(places, np.int64) + 16, heads[:, 2]
    ip = size >= 34
    ip &= (_bytes_at(a, at + 12, ip) == 8) & (_bytes_at(a, at + 13, ip) == 0)
    length = _bytes_at(a, at + 14, ip)
    ip &= length >> 4 == 4
    head = (length & 15) * 4
    total = np.maximum((_bytes_at(a, at + 16, ip) << 8) + _bytes_at(a, at + 17, ip), head)
    end = np.minimum(14 + total, size)
    tcp = at + 14 + head
    is_tcp = ip & (end - 14 - head >= 20)
    is_tcp &= _bytes_at(a, at + 23, is_tcp) == 6
    ports = [pa.array((_bytes_at(a, tcp + k, is_tcp) << 8) + _bytes_at(a, tcp + k + 1, is_tcp),
                      pa.int32(), mask=~is_tcp) for k in (0, 2)]
    low = tcp + (_bytes_at(a, tcp + 12, is_tcp) >> 4) * 4
    high = np.where(is_tcp, at + end, 0)
    payload = [data[x:y] if x < y else None for x, y in zip(low.tolist(), high.tolist())]
    n = len(places)
    return pa.RecordBatch.from_arrays([
        pa.array([trace] * n, pa.string()), pa.array([name] * n, pa.string()),
        pa.array(np.arange(number, number + n)), pa.array(heads[:, 0] + heads[:, 1] / form.ticks),
        _address(a, at + 26, ip), _address(a, at + 30, ip), *ports,
        pa.array(payload, pa.binary()), pa.nulls(n, pa.string()),
    ], schema=_ARROW)


def _error(trace: str, name: str, error: str) -> pa.RecordBatch:
    row = [trace, name, *[None] * 7, error]
    return pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, _ARROW)], schema=_ARROW)


def decode_packets(files: DataFrame) -> DataFrame:
    """Packet rows of all files; a broken file gives one row with its ``error``.

    The way for storage that only Spark's readers reach: a task holds whole files. Set
    ``spark.sql.execution.arrow.maxRecordsPerBatch`` low (say 8) for folders of large captures,
    or use ``read_packets``.
    """
    def decode(batches):
        for batch in batches:
            for trace, name, content in zip(
                batch.column("trace_id").to_pylist(), batch.column("file_name").to_pylist(),
                batch.column("content"),
            ):
                content = content.as_py()
                try:
                    form = _Format(content[:24])
                except ValueError as e:
                    yield _error(trace, name, str(e))
                    continue
                places, _ = form.chain(content, 24, len(content))
                for low in range(0, len(places), PACKETS_PER_BATCH):
                    yield _decoded(content, places[low : low + PACKETS_PER_BATCH], form, trace, name, low)
                if not places:
                    yield _error(trace, name, "capture is empty")

    return files.select("trace_id", "file_name", "content").mapInArrow(decode, PACKETS)


# --- Slices --------------------------------------------------------------------------


def capture_slices(spark: SparkSession, folder: str, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """Byte ranges of all ``*.pcap`` directly in a folder: ``trace_id, file_name, path, size,
    slice, start, stop``. Only names and sizes are read."""
    files = (
        spark.read.format("binaryFile").option("pathGlobFilter", "*.pcap")
        .option("recursiveFileLookup", False).load(folder).select(
            F.md5("path").alias("trace_id"), F.element_at(F.split("path", "/"), -1).alias("file_name"),
            "path", F.col("length").alias("size"))
    )
    last = F.greatest(F.ceil((F.col("size") - 24) / slice_bytes).cast("int") - 1, F.lit(0))
    cut = files.withColumn("slice", F.explode(F.sequence(F.lit(0), last)))
    start = F.col("slice").cast("long") * slice_bytes + 24
    return cut.withColumns({"start": start, "stop": F.least(start + slice_bytes, F.col("size"))})


def _opened(path: str):
    """A file of local or mounted storage, or of any that Arrow knows, open for reading."""
    if "://" not in path and not path.startswith("file:"):
        return pa.OSFile(path)
    from urllib.parse import unquote, urlparse

    parts = urlparse(path)
    if parts.scheme == "file":
        return pa.OSFile(unquote(parts.path))
    from pyarrow import fs

    files, place = fs.FileSystem.from_uri(path)
    return files.open_input_file(place)


def _runs(file, form: _Format, first: int, stop: int, size: int):
    """(bytes, places in them, place in the file after them) of the packets from ``first`` on
    that begin before ``stop``, block by block."""
    at, least = first, 0
    while at < stop and at + 16 <= size:
        file.seek(at)
        data = file.read(min(max(BLOCK_BYTES, least), size - at, stop - at + form.snap + 16 + least))
        places, end = form.chain(data, 0, stop - at)
        yield data, places, at + end
        if places:
            at, least = at + places[-1] + 16 + form.size.unpack_from(data, places[-1] + 8)[0], 0
        elif at + len(data) < size and least <= end:
            least = end + 16  # a packet larger than a block
        else:
            return  # the file ends inside this packet


_FOUND = "trace_id string, file_name string, path string, size long, slice int, start long, stop long, " \
         "first long, reached long, packets long"


def find_packets(slices: DataFrame) -> DataFrame:
    """``slices`` with the place of their first packet, the place after their last one, and the
    number of packets; NULL and 0 where no packet begins in the slice or the file is none."""
    def find(batches):
        for batch in batches:
            rows = []
            for row in batch.to_pylist():
                first = reached = None
                packets = 0
                with _opened(row["path"]) as file:
                    try:
                        form = _Format(head := file.read(28))
                    except ValueError:
                        form = None
                    if form is not None and row["slice"] == 0:
                        first = 24
                    elif form is not None:
                        file.seek(row["start"])
                        near = form.size.unpack_from(head, 24)[0]
                        look = file.read(min(form.snap + CHAIN * 4096, row["size"] - row["start"]))
                        found = form.first(look, near)
                        if found is not None and row["start"] + found < row["stop"]:
                            first = row["start"] + found
                    if first is not None:
                        reached = first
                        for _, places, end in _runs(file, form, first, row["stop"], row["size"]):
                            packets, reached = packets + len(places), end
                rows.append(row | {"first": first, "reached": reached, "packets": packets})
            yield pa.RecordBatch.from_pylist(rows, schema=_FOUND_ARROW)

    return slices.mapInArrow(find, _FOUND)


_FOUND_ARROW = pa.schema([
    ("trace_id", pa.string()), ("file_name", pa.string()), ("path", pa.string()), ("size", pa.int64()),
    ("slice", pa.int32()), ("start", pa.int64()), ("stop", pa.int64()), ("first", pa.int64()),
    ("reached", pa.int64()), ("packets", pa.int64()),
])


def sure_slices(found: DataFrame) -> DataFrame:
    """``trace_id, file_name, path, size, first, stop, number``: slices to decode, with the
    number of their first packet.

    The first slice of a file begins rightly; each next one does if it begins where the packets
    before it end. A file with a slice that does not becomes one slice.
    """
    before = Window.partitionBy("path").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    ended = F.last("reached", ignorenulls=True).over(before)
    right = F.when(F.col("slice") == 0, True).otherwise(
        F.when(F.col("first").isNotNull(), F.col("first") == ended).otherwise(ended >= F.col("stop")))
    checked = found.withColumns({
        "right": F.coalesce(right, F.lit(False)),
        "number": F.coalesce(F.sum("packets").over(before), F.lit(0)),
    })
    files = checked.groupBy("path").agg(F.bool_and("right").alias("sure"))
    out = checked.join(files, "path").where(
        (F.col("slice") == 0) | (F.col("sure") & F.col("first").isNotNull()))
    return out.select(
        "trace_id", "file_name", "path", "size", F.coalesce("first", F.lit(24)).alias("first"),
        F.when(F.col("sure"), F.col("stop")).otherwise(F.col("size")).alias("stop"), "number",
        (F.col("slice") == 0).alias("begins"),
    )


def decode_slices(slices: DataFrame) -> DataFrame:
    """Packet rows of ``sure_slices``, as ``decode_packets`` gives them."""
    def decode(batches):
        for batch in batches:
            for row in batch.to_pylist():
                trace, name, number = row["trace_id"], row["file_name"], row["number"]
                with _opened(row["path"]) as file:
                    try:
                        form = _Format(file.read(24))
                    except ValueError as e:
                        yield _error(trace, name, str(e))
                        continue
                    for data, places, _ in _runs(file, form, row["first"], row["stop"], row["size"]):
                        for low in range(0, len(places), PACKETS_PER_BATCH):
                            part = places[low : low + PACKETS_PER_BATCH]
                            yield _decoded(data, part, form, trace, name, number)
                            number += len(part)
                    if row["begins"] and number == 0 and row["stop"] == row["size"]:
                        yield _error(trace, name, "capture is empty")

    return slices.mapInArrow(decode, PACKETS)


def read_packets(spark: SparkSession, folder: str, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """Packet rows of all captures in a folder: those of ``decode_packets``, from many tasks a
    file. The bytes are read twice, first for the places of the packets.

    The folder must be on storage that the tasks can open (local, mounted, or known to Arrow).
    """
    slices = capture_slices(spark, folder, slice_bytes)
    n = max(1, slices.count())
    dealt = slices.repartition(n, "path", "slice")
    sure = checkpointed(sure_slices(checkpointed(find_packets(dealt))))
    return decode_slices(sure.repartition(n, "path", "first"))


def good_packets(decoded: DataFrame) -> DataFrame:
    return decoded.where(F.col("error").isNull()).drop("error")


def capture_errors(decoded: DataFrame) -> DataFrame:
    return decoded.where(F.col("error").isNotNull()).select("trace_id", "file_name", "error")
