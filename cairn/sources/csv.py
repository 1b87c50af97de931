"""CSV scan with the semantics of the pandas reader the workflow was defined on.

* every field is read as text (``escape='"'`` so doubled quotes collapse); large
  files are split, those with line breaks in quotes too (``cairn.sources.records``);
* header cells are named like pandas: duplicates ``a, a.1, a.2``, blank cells
  ``Unnamed: <i>``; no header → ``"0" .. "n-1"``; names that differ only in case
  are duplicates too while the session does not tell them apart;
* a row with anything beyond the header's fields is an error, however many empty
  fields stand before it (a shorter row is filled with missing values);
* the pandas default NA tokens become NULL;
* kinds are decided in one aggregation over all rows and numeric columns are
  parsed with the configured decimal separator (``"1,5"`` → 1.5), booleans
  become 1.0/0.0.

Files under one path are grouped by header line and their columns matched by name.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import replace

from pyspark.sql import DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F

from cairn.config import FileSpec
from cairn.functions.numeric import parse_decimal
from cairn.functions.text import na_to_null
from cairn.operators.profile import BOOL_TOKENS, text_counts, text_kind

# Charsets Spark reads without the legacy-charset switch.
STANDARD_CHARSETS = {"utf-8", "utf8", "utf-16", "utf-16le", "utf-16be", "utf-32", "utf-32le", "utf-32be",
                     "iso-8859-1", "us-ascii"}
CHARSET_ALIASES = {"utf-8-sig": "utf-8", "ascii": "us-ascii", "utf8": "utf-8"}
# Detected encodings that decode ASCII bytes as ASCII (a folder of ASCII files and files in
# one of these is read with that one).
ASCII_SUPERSETS = {"utf-8", "windows-1252", "shift_jis", "cp932"}


def spark_charset(encoding: str) -> str:
    e = encoding.strip().lower()
    return CHARSET_ALIASES.get(e, e)


def pandas_style_names(raw: list[str | None], case_sensitive: bool = True) -> list[str]:
    """Header cells → unique names the way pandas names them."""
    fold = (lambda n: n) if case_sensitive else str.lower
    names: list[str] = []
    for i, cell in enumerate(raw):
        names.append(f"Unnamed: {i}" if cell is None or cell == "" else cell)
    seen: dict[str, int] = {}
    used = {fold(n) for n in names}
    out = []
    for name in names:
        k = seen.get(fold(name), 0)
        if k == 0:
            out.append(name)
            seen[fold(name)] = 1
            continue
        new = f"{name}.{k}"
        while fold(new) in used:
            k += 1
            new = f"{name}.{k}"
        seen[fold(name)] = k + 1
        used.add(fold(new))
        out.append(new)
    return out


#: What a row holds beyond the header's fields.
EXTRA = "_cairn_extra"
LEGACY = "spark.sql.legacy.javaCharsets"


@contextmanager
def charsets(spark: SparkSession, charset: str) -> Iterator[None]:
    """Lets Spark read a charset beyond its standard ones; the session's own setting comes back."""
    if charset in STANDARD_CHARSETS:
        yield
        return
    before = spark.conf.get(LEGACY, None)
    spark.conf.set(LEGACY, "true")
    try:
        yield
    finally:
        spark.conf.unset(LEGACY) if before is None else spark.conf.set(LEGACY, before)


def _reader(spark: SparkSession, spec: FileSpec, charset: str) -> DataFrameReader:
    return (
        spark.read.option("sep", spec.delimiter)
        .option("encoding", charset)
        .option("multiLine", str(spec.multi_line is not False).lower())
        .option("quote", '"')
        .option("escape", '"')
        .option("inferSchema", "false")
        .option("mode", "PERMISSIVE")
    )


def read_raw(spark: SparkSession, spec: FileSpec, encoding: str = "utf-8", paths: list[str] | None = None, in_parallel: bool = False) -> DataFrame:
    """All-text frame with pandas-style column names (NA tokens not yet applied).

    ``paths`` reads several files with the same header in one scan (default:
    ``spec.path``); ``in_parallel`` reads quoted line breaks by splits. The
    frame's last column, ``EXTRA``, holds what a row has beyond the header;
    :func:`type_columns` refuses rows with it.
    """
    from cairn.session import materialize
    from cairn.sources.records import parsed, quoted_records, surplus

    charset = spark_charset(encoding)
    src = paths or spec.path
    with charsets(spark, charset):
        first = _reader(spark, spec, charset).option("header", "false").csv(src).limit(1).collect()
        if not first:
            raise ValueError(f"CSV is empty: {spec.path}")
        width = len(first[0])
        sensitive = str(spark.conf.get("spark.sql.caseSensitive")).lower() == "true"
        names = pandas_style_names(list(first[0]), sensitive) if spec.has_header else [str(i) for i in range(width)]
        if in_parallel:
            records = quoted_records(spark, paths or [spec.path], spec.delimiter, charset)
            df = parsed(records.where("NOT first") if spec.has_header else records, width, spec.delimiter, EXTRA)
        else:
            # the corrupt-record column holds a row whose number of fields is another one
            schema = ", ".join([*[f"_c{i} string" for i in range(width)], f"{EXTRA} string"])
            df = (_reader(spark, spec, charset).schema(schema).option("columnNameOfCorruptRecord", EXTRA)
                  .option("header", str(spec.has_header).lower()).option("enforceSchema", "true").csv(src))
        df = df.withColumn(EXTRA, surplus(F.col(EXTRA), width, spec.delimiter)).toDF(*names, EXTRA)
        if in_parallel or charset in STANDARD_CHARSETS:
            return df
        # the setting must hold while the file is read, so such a file is read now
        return materialize(df.toDF(*[f"c{i}" for i in range(width + 1)]), "csv-raw").toDF(*names, EXTRA)


def type_columns(df: DataFrame, decimal: str = ".") -> tuple[DataFrame, dict[str, str]]:
    """NA tokens → NULL, kinds from one aggregation, numeric text → double; rows that are too long are refused."""
    names = [c for c in df.columns if c != EXTRA]
    # columns by place until the last step: names may hold anything
    place = [f"c{i}" for i in range(len(df.columns))]
    clean = df.toDF(*place)
    has_extra = len(names) < len(df.columns)
    extra = place[df.columns.index(EXTRA)] if has_extra else None
    own = [p for p in place if p != extra]
    clean = clean.select(*[na_to_null(F.col(p)).alias(p) for p in own], *([F.col(extra)] if extra else []))
    counts = text_counts(clean, own + ([extra] if extra else []), decimal)
    if extra and counts[extra]["n"]:
        raise ValueError(f"{counts[extra]['n']} CSV row(s) have more fields than the {len(own)} of the header")
    kinds = {p: text_kind(counts[p]) for p in own}
    cols = []
    for p in own:
        col = F.col(p)
        if kinds[p] == "numeric":
            is_bool = col.isin(*BOOL_TOKENS)
            as_bool = F.when(col.isin("True", "TRUE", "true"), 1.0).otherwise(0.0)
            cols.append(F.when(is_bool, as_bool).otherwise(parse_decimal(col, decimal)).alias(p))
        else:
            cols.append(col)
    return clean.select(*cols).toDF(*names), dict(zip(names, kinds.values()))


def csv_inventory(spark: SparkSession, spec: FileSpec) -> list:
    """The inventory's row per file; without a look at encodings if one is configured."""
    from cairn.sources.encoding import encoding_inventory

    return encoding_inventory(spark, spec.path, spec.encoding).collect()


def csv_encoding(spark: SparkSession, spec: FileSpec, inventory: list | None = None) -> str:
    """The configured encoding (stripped, lower-cased), else the one that the inventory finds."""
    if spec.encoding:
        return spec.encoding.strip().lower()
    rows = csv_inventory(spark, spec) if inventory is None else inventory
    encs = sorted({r["encoding"] for r in rows})
    others = [e for e in encs if e != "ascii"]
    if len(others) == 1 and others[0] in ASCII_SUPERSETS:
        encs = others  # pure-ASCII files read the same under the other encoding
    if len(encs) > 1:
        raise ValueError(f"files under {spec.path} use several encodings {encs}; use read_csv_folder")
    return encs[0] if encs else "utf-8"


def read_csv(spark: SparkSession, spec: FileSpec, encoding: str | None = None, inventory: list | None = None) -> tuple[DataFrame, dict[str, str], str]:
    """Typed frame, column kinds and the encoding used.

    Several files are grouped by their header and matched by column name. The
    inventory is taken once and may be handed on (:func:`csv_inventory`).
    """
    from cairn.sources.encoding import read_csv_folder

    inventory = csv_inventory(spark, spec) if inventory is None else inventory
    encoding = encoding or csv_encoding(spark, spec, inventory)
    typed, kinds, _ = read_csv_folder(spark, replace(spec, encoding=encoding, check_exists=False), inventory)
    return typed, kinds, encoding
