"""Encoding inventory: which charset is each file under a path? (a Spark job over the files' lines)

The text reader hands over each line's bytes as they are and splits large
files, so no file is held whole (one without any ``\\n`` is one line). Spark's
own expressions tell of every line whether it is ASCII and strict UTF-8; only
files with lines that are neither are looked at once more, in Python: which of
those lines are Shift-JIS or CP932 text with CJK characters (none of these
encodings carries a state from line to line). Rule order: byte-order mark →
ASCII → strict UTF-8 → Shift-JIS / CP932 when every line decodes and CJK text
occurs → windows-1252. The reader drops a UTF-8 mark by itself; the three bytes
by which the lines fall short of the file's size give it away. The first line's
hash groups files by header; lines that leave a quote open tell whether a file
may hold quoted line breaks, and carriage returns within lines that it has line
ends of another kind.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairn.config import FileSpec

# Byte-order marks and the CJK code point ranges used to accept Shift-JIS.
BOMS = (
    (b"\xef\xbb\xbf", "utf-8-sig"),
    (b"\xff\xfe\x00\x00", "utf-32"),
    (b"\x00\x00\xfe\xff", "utf-32"),
    (b"\xff\xfe", "utf-16"),
    (b"\xfe\xff", "utf-16"),
)
CJK_RANGES = ((0x3040, 0x30FF), (0x4E00, 0x9FFF), (0xFF66, 0xFF9D))
JAPANESE = ("shift_jis", "cp932")
FALLBACK = "windows-1252"
#: What a line tells: decodes as the encoding, and (Japanese ones) has CJK text.
FLAGS = ("ascii", "utf8", "shift_jis", "cp932", "cjk_shift_jis", "cjk_cp932")


def _decodes(line: bytes, encoding: str) -> str | None:
    try:
        return line.decode(encoding)
    except UnicodeDecodeError:
        return None


def _has_cjk(text: str | None) -> bool:
    return text is not None and any(lo <= ord(ch) <= hi for ch in text for lo, hi in CJK_RANGES)


def line_flags(line: bytes) -> tuple[bool, ...]:
    """The FLAGS of one line."""
    if line.isascii():
        return (True, True, True, True, False, False)
    texts = [_decodes(line, name) for name in JAPANESE]
    return (False, _decodes(line, "utf-8") is not None, *[t is not None for t in texts], *[_has_cjk(t) for t in texts])


def detect_bytes(data: bytes) -> str:
    """The rules on one piece of bytes in memory."""
    for bom, name in BOMS:
        if data.startswith(bom):
            return name
    told = dict(zip(FLAGS, line_flags(data)))
    if told["ascii"] or told["utf8"]:
        return "ascii" if told["ascii"] else "utf-8"
    return next((name for name in JAPANESE if told[name] and told[f"cjk_{name}"]), FALLBACK)


def file_facts(spark: SparkSession, path: str | list[str], encodings: bool = True) -> DataFrame:
    """Per non-empty file, from its lines alone: size, header hash, open quotes, carriage returns and (``encodings``) its marks and flags."""
    lines = spark.read.option("lineSep", "\n").text(path).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("length"), "value",
        # the line that starts a file: the first row of its first block
        F.when(F.col("_metadata.file_block_start") == 0, F.monotonically_increasing_id()).alias("at"))
    size = F.octet_length("value")
    quotes = size - F.octet_length(F.replace("value", F.lit('"')))
    # only a carriage return that is followed by something ends a line of its own
    returns = F.instr(F.substring(F.col("value"), 1, F.greatest(F.length("value") - 1, F.lit(0))), "\r") > 0
    # only the first line of a file is hashed
    header = F.when(F.col("at").isNotNull(), F.xxhash64(F.col("value").cast("binary")))
    told = [F.max("length").alias("length"), F.sum(quotes % 2).alias("open_quotes"), F.bool_or(returns).alias("returns"),
            F.min_by(header, "at").alias("header")]
    if encodings:
        raw = F.hex(F.substring(F.col("value").cast("binary"), 1, 4))
        mark = F.lit(None).cast("int")
        for k in reversed(range(len(BOMS))):
            mark = F.when(raw.startswith(BOMS[k][0].hex().upper()), k).otherwise(mark)
        valid = F.is_valid_utf8("value")
        told += [F.bool_and(valid & (F.char_length("value") == size)).alias("ascii"), F.bool_and(valid).alias("utf8"), F.sum(size + 1).alias("bytes"),
                 F.min_by(F.when(F.col("at").isNotNull(), mark), "at").alias("mark")]
    return lines.groupBy("path").agg(*told)


def japanese_files(spark: SparkSession, paths: list[str]) -> dict[str, str]:
    """Of files that are not UTF-8: the Japanese encoding in which all their lines decode, with CJK text in one."""
    lines = spark.read.option("lineSep", "\n").text(paths).where(~F.is_valid_utf8("value")).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").cast("binary").alias("line"))

    def classify(batches):
        import numpy as np
        import pyarrow as pa

        for b in batches:
            flags = np.array([line_flags(x)[2:] for x in b.column("line").to_pylist()], bool).reshape(b.num_rows, 4)
            yield pa.RecordBatch.from_arrays([b.column("path"), *[pa.array(flags[:, k]) for k in range(4)]], names=["path", *FLAGS[2:]])

    told = lines.mapInArrow(classify, "path string, " + ", ".join(f"{f} boolean" for f in FLAGS[2:]))
    files = told.groupBy("path").agg(*[(F.bool_or if f.startswith("cjk") else F.bool_and)(f).alias(f) for f in FLAGS[2:]])
    return {r["path"]: name for r in files.collect() for name in reversed(JAPANESE) if r[name] and r[f"cjk_{name}"]}


INVENTORY = "path string, length long, encoding string, header string, open_quotes long, returns boolean"


def encoding_inventory(spark: SparkSession, path: str | list[str], encoding: str | None = None) -> DataFrame:
    """(path, length, encoding, header, open_quotes, returns) per non-empty file under ``path`` (a file, folder or glob).

    ``header`` is the hash of the first line's bytes; ``open_quotes`` counts
    lines with an odd number of quotes; ``returns`` tells of carriage returns
    within lines. A given ``encoding`` is every file's, and nothing is looked
    at to find one. One small row per file passes through the driver.
    """
    facts = file_facts(spark, path, encoding is None).collect()
    other = [r["path"] for r in facts if encoding is None and r["mark"] is None and not r["utf8"]]
    japanese = japanese_files(spark, other) if other else {}

    def verdict(r) -> str:
        if encoding is not None:
            return encoding.strip().lower()
        if r["mark"] is not None:
            return BOMS[r["mark"]][1]
        # a last line without an end counts one byte too many
        if r["utf8"] and r["length"] - r["bytes"] in (2, 3):
            return "utf-8-sig"
        return "ascii" if r["ascii"] else "utf-8" if r["utf8"] else japanese.get(r["path"], FALLBACK)

    rows = [(r["path"], r["length"], verdict(r), str(r["header"]), r["open_quotes"], r["returns"]) for r in facts]
    return spark.createDataFrame(rows, INVENTORY)


def read_csv_folder(spark: SparkSession, spec: FileSpec, inventory: list | None = None) -> tuple[DataFrame, dict[str, str], list[str]]:
    """Read every file under ``spec.path`` with its own encoding; union by column name.

    Files sharing an encoding and a header line are read together in one scan,
    so the plan grows with the number of distinct (encoding, header) pairs, not
    with the number of files. One small row per file reaches the driver.
    Quoted line breaks are read by splits; only files whose line ends are no
    single ``\\n`` byte (UTF-16 and UTF-32, carriage returns alone) are read
    whole where they hold any.
    """
    from cairn.sources.csv import read_raw, type_columns

    inv = encoding_inventory(spark, spec.path, spec.encoding).collect() if inventory is None else inventory
    groups: dict[tuple[str, str], list] = {}
    for r in inv:
        groups.setdefault((spec.encoding or r["encoding"], r["header"] if spec.has_header else ""), []).append(r)
    if not groups:
        raise ValueError(f"CSV is empty: {spec.path}")
    frames = []
    for (enc, _), files in sorted(groups.items(), key=lambda g: g[0]):
        wide = enc.startswith(("utf-16", "utf-32"))  # their line ends are no single bytes
        multi = spec.multi_line if spec.multi_line is not None else wide or any(f["open_quotes"] for f in files)
        in_parallel = bool(multi) and not wide and not any(f["returns"] for f in files)
        paths = sorted(f["path"] for f in files)
        sub = FileSpec(paths[0], enc, spec.delimiter, spec.decimal, spec.has_header, multi, check_exists=False)
        frames.append(read_raw(spark, sub, enc, paths=paths, in_parallel=in_parallel))
    raw = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
    typed, kinds = type_columns(raw, spec.decimal)
    return typed, kinds, sorted({enc for enc, _ in groups})
