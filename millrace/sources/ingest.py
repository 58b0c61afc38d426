"""Reading: file listings, format sniffing, content hashes, ordered snapshots, and the good / quarantine split."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..tables import ranked


# Extensions of folders that count as one document or program.
PACKAGES = "app|bundle|framework|plugin|kext|rtfd|pages|numbers|key|xcodeproj|photoslibrary"


def scan_files(spark: SparkSession, folders: list[str]) -> DataFrame:
    """Files below folders as path, modificationTime, length, content, without hidden ones and those in packages; one row for each path,
    ordered by path. Spark's readers pass over names that start with a dot or an underscore, so a hidden file cannot be chosen by name either."""
    read = lambda paths: spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths)
    found = None
    for folder in folders:
        rows = read(folder)
        root = F.regexp_replace(F.lit(folder), "^file:/*", "/")
        below = F.expr("substring(path, instr(path, root) + length(root))")
        rows = rows.withColumn("root", F.regexp_replace(root, "/+$", "")).withColumn("below", below).where(_listed(F.col("below"))).drop("root", "below")
        found = rows if found is None else found.unionByName(rows)
    return found.dropDuplicates(["path"]).orderBy("path")


def _listed(path: Column) -> Column:
    return ~path.rlike(rf"/\.[^/]|\.(?i:{PACKAGES})/")


def manifest(files: DataFrame, path: str = "path", root: str = "") -> DataFrame:
    """Rows whose path below ``root`` has no hidden part and no package, one for each path, ordered by path."""
    rest = F.regexp_replace(path, "^" + root, "") if root else F.col(path)
    return files.where(_listed(rest)).dropDuplicates([path]).orderBy(path)


def content_hash(rows: DataFrame, content: str, key: str) -> DataFrame:
    return rows.select(key, F.sha2(content, 256).alias("content_hash"), F.octet_length(content).cast("long").alias("byte_count"))


# Leading bytes (hexadecimal) by which binary formats are told.
SIGNATURES = {
    "504B0304": "zip", "504B0506": "zip", "504B0708": "zip", "D0CF11E0A1B11AE1": "ole", "89504E47": "binary", "FFD8FF": "binary", "474946383761": "binary", "474946383961": "binary", "52494646": "binary", "664C6143": "binary", "4F676753": "binary",
    "53514C69746520666F726D61742033": "binary", "1F8B": "binary", "377ABCAF271C": "binary", "526172211A07": "binary", "7F454C46": "binary", "CFFAEDFE": "binary", "CEFAEDFE": "binary", "FEEDFACF": "binary", "FEEDFACE": "binary", "CAFEBABE": "binary", "62706C6973743030": "binary",
}


def sniff_format(content: Column, name: Column) -> Column:
    """Format by leading bytes; by the name's extension only for text that starts with a tag. ``content``: bytes."""
    head = F.hex(F.substring(content, 1, 16))
    text = F.lower(F.ltrim(F.decode(F.substring(content, 1, 512), "ISO-8859-1")))
    latin = lambda n: F.decode(F.substring(content, 1, n), "ISO-8859-1")
    trimmed = F.regexp_replace(latin(1024), r"^[\x00\x09-\x0D\x20]+", "")
    out = F.when(trimmed.startswith("%PDF-"), "pdf")
    for signature, kind in SIGNATURES.items():
        out = out.when(head.startswith(signature), kind)
    out = out.when(latin(32).rlike(r"^[\x09-\x0D\x20]*\{\\rtf"), "rtf")
    html = text.startswith("<!doctype html") | text.startswith("<html") | (F.lower(name).rlike(r"\.x?html?$") & text.startswith("<"))
    return out.when(html, "html").otherwise("text")


# Leading bytes (hexadecimal) of media containers.
_MEDIA = {
    "FFD8FF": "jpeg", "89504E470D0A1A0A": "png", "474946383761": "gif", "474946383961": "gif", "49492A00": "tiff", "4D4D002A": "tiff", "49492B00": "tiff", "4D4D002B": "tiff", "00000100": "ico", "00000200": "ico", "69636E73": "icns", "38425053": "psd",
    "762F3101": "exr", "0000000C6A5020200D0A870A": "jp2", "FF4FFF51": "jp2", "63616666": "caf", "664C6143": "flac", "2E736E64": "au", "4F676753": "ogg", "2321414D52": "amr", "494433": "mp3",
}
_LATER = {"1A45DFA3": "mkv", "464C56": "flv", "000001BA": "mpg", "000001B3": "mpg"}
# Brands of still images in the base media format.
_HEIC = "heic|heix|hevc|hevx|heim|heis|mif1|msf1"
# Fixed value: bytes of a file that are looked at.
_HEAD = 65_536


def sniff_media(content: Column) -> Column:
    """Media container by magic bytes, null if none. A UTF-16 or UTF-32 byte-order mark is never audio."""
    head = F.hex(F.substring(content, 1, 64))
    at = lambda byte, n: F.substring(head, 2 * byte + 1, 2 * n)
    out = F.when(F.lit(False), F.lit(""))
    for signature, kind in _MEDIA.items():
        out = out.when(head.startswith(signature), kind)
    out = out.when(head.startswith("424D") & (at(6, 4) == "00000000") & (F.octet_length(content) >= 14), "bmp")
    riff = head.startswith("52494646") | head.startswith("52494658") | head.startswith("52463634")
    for form, kind in (("57454250", "webp"), ("57415645", "wav"), ("41564920", "avi")):
        out = out.when(riff & (at(8, 4) == form), kind)
    out = out.when(head.startswith("464F524D") & at(8, 4).isin("41494646", "41494643"), "aiff")
    out = out.when(head.startswith("FFFE"), None).when(head.rlike("^FF[EF]"), F.when(head.rlike("^FFF[0189]"), "aac").otherwise("mp3"))
    for signature, kind in _LATER.items():
        out = out.when(head.startswith(signature), kind)
    return out.otherwise(F.transform(F.array(F.substring(content, 1, _HEAD)), _box)[0])


def _box(content: Column) -> Column:
    """Format by the first box that is no padding, however many come before it: none is of under eight bytes."""
    part = lambda offset, n: F.substring(content, (offset + 1).cast("int"), F.lit(n))
    size = lambda offset: F.conv(F.hex(part(offset, 4)), 16, 10).cast("long")
    name = lambda offset: F.decode(part(offset + 4, 4), "ISO-8859-1")
    padding = lambda offset: name(offset).isin("free", "wide", "skip") & (size(offset) >= 8) & (size(offset) <= F.octet_length(content) - offset)
    # position after all boxes of padding
    none = F.lit(0).cast("long")
    steps = F.when(padding(none), F.sequence(F.lit(1), F.greatest(F.octet_length(content) / 8, F.lit(1)).cast("int"))).otherwise(F.array().cast("array<int>"))
    last = F.aggregate(steps, none, lambda offset, _: F.when(padding(offset), offset + size(offset)).otherwise(offset))
    brand = lambda offset: F.decode(part(offset + 8, 4), "ISO-8859-1")
    of_brand = lambda o: F.when(brand(o).rlike(f"^(?:{_HEIC})$"), "heic").when(brand(o).isin("avif", "avis"), "avif").when(brand(o) == "qt  ", "mov").when(brand(o) == "M4A ", "m4a").otherwise("mp4")
    read = lambda o: F.when(name(o) == "ftyp", of_brand(o)).when(name(o).isin("moov", "mdat"), "mov")
    return F.transform(F.array(last), read)[0]


def decode_text(content: Column) -> Column:
    """Text of a byte column by byte-order mark, zero-byte lanes or strict UTF-8; null where it is malformed."""

    # a local function, so that executors need no module of this package for a column
    def read(b: bytes) -> str | None:
        size = len(b)
        start, label = 0, "utf-8"
        for mark, named in ((b"\xff\xfe\0\0", "utf-32-le"), (b"\0\0\xfe\xff", "utf-32-be"), (b"\xff\xfe", "utf-16-le"), (b"\xfe\xff", "utf-16-be"), (b"\xef\xbb\xbf", "utf-8")):
            if b.startswith(mark):
                start, label = len(mark), named
                break
        else:
            first, second = b[0::2].count(0), b[1::2].count(0)
            quarters = size // 4
            least = max(1, size // 2 // 20)
            if size and size % 4 == 0 and b[2::4].count(0) == b[3::4].count(0) == quarters:
                label = "utf-32-le"
            elif size and size % 4 == 0 and b[0::4].count(0) == b[1::4].count(0) == quarters:
                label = "utf-32-be"
            elif size % 2 == 0 and second > 4 * first and second >= least:
                label = "utf-16-le"
            elif size % 2 == 0 and first > 4 * second and first >= least:
                label = "utf-16-be"
        try:
            return b[start:].decode(label)
        except UnicodeDecodeError:
            return None

    @F.arrow_udf("string")
    def decoded(column: pa.Array) -> pa.Array:
        return pa.array((read(b.as_py()) if b.is_valid else None for b in column), pa.string(), size=len(column))

    return decoded(content)


def split_errors(rows: DataFrame, error: Column) -> tuple[DataFrame, DataFrame]:
    """(good, quarantined): rows without and with an error message; one bad row never stops the others."""
    marked = rows.withColumn("error", error)
    return marked.where("error IS NULL").drop("error"), marked.where("error IS NOT NULL")


def import_report(outcomes: DataFrame) -> DataFrame:
    """kb_id, position, text: a summary of each knowledge base (position 0) and the distinct messages of its failures in order, from rows (kb_id,
    outcome, message)."""
    summary = F.format_string("%d imported, %d skipped, %d failed", "imported", "skipped", "failed")
    counts = outcomes.groupBy("kb_id").agg(*(F.count(F.when(F.col("outcome") == o, 1)).alias(o) for o in ("imported", "skipped", "failed")))
    failures = in_order(outcomes.where("outcome = 'failed'").select("kb_id", F.col("message").alias("text")).distinct(), F.asc("text"))
    return counts.select("kb_id", F.lit(0).cast("long").alias("position"), summary.alias("text")).unionByName(failures.select("kb_id", "position", "text"))


def in_order(rows: DataFrame, *keys: Column, group: str = "kb_id") -> DataFrame:
    """Rows with their position from 1 within a group, in an order that has to be stated in full. A group may hold any part of the rows: ranges
    of the order are dealt out and counted, no task sorts a whole group."""
    return ranked(rows, [F.asc_nulls_first(group), *keys], "position", "in-order", group=group).withColumn("position", F.col("position") + 1)
