"""One pass over file contents: format, bounded header facts and content digests.

Each task opens its files one by one, reads the header under a cap and, if asked, streams the whole
file once for its digests. Errors become values in the row, so a bad file never fails the job. File
contents never enter Spark; only facts do.
"""

from __future__ import annotations

import hashlib
import io
import os
from collections.abc import Callable, Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from shelfmark import schemas
from shelfmark.functions.identity import (
    field,
    kind_of_gguf,
    kind_of_safetensors,
    quant_of_file_type,
)
from shelfmark.session import written
from shelfmark.sources import gguf

# ---- fixed values ---------------------------------------------------------------------------
SNIFF_BYTES = 64
SAFETENSORS_HEADER_USUAL = 8 << 20
HASH_STEP = 1 << 20
PARTIAL_WINDOW = 64 << 10
PIECE_SIZE = 16 << 20
FAN_OUT = 64
# Put before what is digested, so that a piece and a row of digests never look alike.
_LEAF, _NODE = b"\x00", b"\x01"
# ---- end of fixed values --------------------------------------------------------------------

_RAW = schemas.table(
    "format string, parse_error string, general_name string, basename string, finetune string, "
    "arch string, params_total double, params_active double, context_len long, file_type long, "
    "safetensors_header string, sha256 string, partial_digest string, hash_error string"
)
_PYTORCH_ENDINGS = (".pt", ".pth", ".bin")


#: Bytes of header texts that one Arrow piece gathers, and rows at most.
PIECE_BYTES, PIECE_ROWS = 16 << 20, 256


def sniff(head: bytes, path: str, size: int = 0) -> str:
    """Format by magic, else by the shape of a safetensors header (of usual length, or of any that fits
    into the file's `size`), else by extension."""
    if head[:4] == gguf.MAGIC:
        return "gguf"
    length = int.from_bytes(head[:8], "little")
    if head[8:9] == b"{" and 2 <= length <= max(SAFETENSORS_HEADER_USUAL, size - 8):
        return "safetensors"
    ending = os.path.splitext(path)[1].lower()
    if ending == ".onnx":
        return "onnx"
    return "pytorch" if ending in _PYTORCH_ENDINGS else "unknown"


def _header_facts(source: BinaryIO, path: str, options: dict) -> dict:
    try:
        size = source.seek(0, io.SEEK_END)
        source.seek(0)
        head = source.read(SNIFF_BYTES)
    except OSError:
        return {"format": "unknown"}
    facts = {"format": sniff(head, path, size)}
    try:
        if facts["format"] == "gguf":
            facts |= gguf.read_facts(source, **options)
        elif facts["format"] == "safetensors":
            length = int.from_bytes(head[:8], "little")
            if length > size - 8:
                raise gguf.HeaderError("header_too_large")
            text = (head[8:] + source.read(max(0, length + 8 - len(head))))[:length]
            facts["safetensors_header"] = text.decode("utf-8")
    except gguf.HeaderError as error:
        facts["parse_error"] = str(error)
    except UnicodeDecodeError:
        facts["parse_error"] = "safetensors.bad_json"
    except OSError:
        facts["parse_error"] = "header_too_large"
    return facts


def _digests(source: BinaryIO) -> dict:
    """SHA-256 of everything, and of the first and last 64 KiB (of everything up to 128 KiB)."""
    full = hashlib.sha256()
    head, tail, size = b"", b"", 0
    try:
        source.seek(0)
        while chunk := source.read(HASH_STEP):
            full.update(chunk)
            size += len(chunk)
            head += chunk[: PARTIAL_WINDOW - len(head)] if len(head) < PARTIAL_WINDOW else b""
            tail = (tail + chunk[-PARTIAL_WINDOW:])[-PARTIAL_WINDOW:]
    except OSError as error:
        return {"hash_error": f"scan.io:{error.errno}"}
    edges = head + tail if size > 2 * PARTIAL_WINDOW else None
    partial = hashlib.sha256(edges) if edges is not None else full
    return {"sha256": full.hexdigest(), "partial_digest": partial.hexdigest()}


def _edges(path: str) -> dict:
    """Partial digest by reading no more than the edges; `sha256` too where they are the whole file."""
    try:
        with open(path, "rb", buffering=0) as source:
            size = source.seek(0, io.SEEK_END)
            whole = size <= 2 * PARTIAL_WINDOW
            source.seek(0)
            data = _exactly(source, size if whole else PARTIAL_WINDOW)
            if not whole:
                source.seek(size - PARTIAL_WINDOW)
                data += _exactly(source, PARTIAL_WINDOW)
    except OSError as error:
        return {"hash_error": f"scan.io:{error.errno}", "bytes_read": 0}
    digest = hashlib.sha256(data).hexdigest()
    return {"partial_digest": digest, "sha256": digest if whole else None, "bytes_read": len(data)}


def _exactly(source: BinaryIO, count: int) -> bytes:
    """The next `count` bytes, fewer at the end of the file."""
    data = bytearray()
    while len(data) < count and (more := source.read(min(HASH_STEP, count - len(data)))):
        data += more
    return bytes(data)


def _piece(path: str, start: int, length: int) -> dict:
    """Digest of a byte range, read in steps."""
    digest, left = hashlib.sha256(_LEAF), length
    try:
        with open(path, "rb", buffering=0) as source:
            source.seek(start)
            while left and (chunk := source.read(min(HASH_STEP, left))):
                digest.update(chunk)
                left -= len(chunk)
    except OSError as error:
        return {"piece_error": f"scan.io:{error.errno}"}
    return {"piece_error": "scan.short"} if left else {"piece_digest": digest.hexdigest()}


def _examine(paths: list[str], wants_hash: list[bool], wants_header: list[bool], options: dict):
    for path, hash_it, read_header in zip(paths, wants_hash, wants_header):
        row: dict = {}
        if hash_it or read_header:
            try:
                with open(path, "rb") as source:
                    if read_header:
                        row |= _header_facts(source, path, options)
                    if hash_it:
                        row |= _digests(source)
            except OSError as error:
                row = {"format": "unknown", "hash_error": f"scan.io:{error.errno}"}
        yield row


def _with_rows(batch: pa.RecordBatch, rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    """The columns of `batch` that `schema` keeps, and beside them what was found for each row."""
    columns = [
        batch.column(f.name)
        if f.name in batch.schema.names
        else pa.array([row.get(f.name) for row in rows], type=f.type)
        for f in schema
    ]
    return pa.RecordBatch.from_arrays(columns, schema=schema)


def _arrow_job(rows_of: Callable[[pa.RecordBatch], Iterator[dict]], schema: pa.Schema):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # Pieces by the bytes they gather, because a header text can have megabytes.
            start, rows, held = 0, [], 0
            for row in rows_of(batch):
                rows.append(row)
                held += len(row.get("safetensors_header") or "")
                if held >= PIECE_BYTES or len(rows) >= PIECE_ROWS:
                    yield _with_rows(batch.slice(start, len(rows)), rows, schema)
                    start, rows, held = start + len(rows), [], 0
            yield _with_rows(batch.slice(start, len(rows)), rows, schema)

    return run


def _arrow_schema(schema: StructType) -> pa.Schema:
    types = {"string": pa.string(), "long": pa.int64(), "bigint": pa.int64(),
             "double": pa.float64(), "boolean": pa.bool_()}
    return pa.schema([(f.name, types[f.dataType.simpleString()]) for f in schema.fields])


def examine_files(
    listing: DataFrame,
    digests: bool = True,
    headers: bool = True,
    active_key: str = "",
    max_array: int | None = None,
    max_string: int | None = None,
    max_nesting: int | None = None,
    tasks: int | None = None,
) -> DataFrame:
    """`listing` (`schemas.LISTING`) with header facts and digests of its readable regular files.

    A column `needs_hash`, if there, says whose digests to read. Files are dealt to `tasks` (by default
    as many as there are shuffle partitions, and always that many) by size: see `deal_by_size`. One
    file's digest cannot be split, so use many more tasks than cores.
    """
    options = {"active_key": active_key, "max_array": max_array, "max_string": max_string, "max_nesting": max_nesting}
    schema = StructType(schemas.LISTING.fields + _RAW.fields)

    def rows_of(batch: pa.RecordBatch) -> Iterator[dict]:
        get = {n: batch.column(n).to_pylist() for n in ("root_path", "rel_path")}
        plain = [
            readable and not link
            for readable, link in zip(
                batch.column("readable").to_pylist(), batch.column("is_symlink").to_pylist()
            )
        ]
        paths = [os.path.join(r, p) for r, p in zip(get["root_path"], get["rel_path"])]
        asked = batch.column("needs_hash").to_pylist()
        return _examine(
            paths, [p and digests and a for p, a in zip(plain, asked)], [p and headers for p in plain], options
        )

    if "needs_hash" not in listing.columns:
        listing = listing.withColumn("needs_hash", F.lit(True))
    dealt = deal_by_size(listing.select(*schemas.LISTING.names, "needs_hash"), tasks)
    found = dealt.mapInArrow(_arrow_job(rows_of, _arrow_schema(schema)), schema)
    return _finish(found, schemas.LISTING.names)


def edge_digests(listing: DataFrame, tasks: int | None = None) -> DataFrame:
    """`root_id, rel_path, partial_digest, sha256, hash_error, bytes_read` of readable regular files by their edges
    alone: at most 128 KiB of a file are read, and `sha256` is there if these are all of it."""
    found = schemas.table("partial_digest string, sha256 string, hash_error string, bytes_read long")
    schema = StructType([f for f in schemas.LISTING.fields if f.name in ("root_id", "rel_path")] + found.fields)

    def rows_of(batch: pa.RecordBatch) -> Iterator[dict]:
        for root, path in zip(batch.column("root_path").to_pylist(), batch.column("rel_path").to_pylist()):
            yield _edges(os.path.join(root, path))

    plain = listing.where("readable and not is_symlink").select(*schemas.LISTING.names)
    return deal_by_size(plain, tasks).mapInArrow(_arrow_job(rows_of, _arrow_schema(schema)), schema)


# ---- digest trees ---------------------------------------------------------------------------


def pieces_of(files: DataFrame, size: Column, piece: int) -> DataFrame:
    """A row for each piece of each file: `piece, start, length`. An empty file has one empty piece."""
    last = F.greatest(F.lit(0).cast("long"), F.ceil(size / piece) - 1)
    start = F.col("piece") * F.lit(piece).cast("long")
    return (
        files.withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), last)))
        .withColumn("start", start)
        .withColumn("length", F.least(F.lit(piece).cast("long"), size - start))
    )


def piece_digests(listing: DataFrame, piece: int = PIECE_SIZE, tasks: int | None = None) -> DataFrame:
    """Digests of the byte ranges of readable regular files: `root_id, rel_path, piece, start, length, piece_digest,
    piece_error`. Ranges, not files, are dealt to `tasks`, so that many tasks read one very large file."""
    found = schemas.table("piece_digest string, piece_error string")
    given = schemas.table("root_id long, rel_path string, piece long, start long, length long")
    schema = StructType(given.fields + found.fields)
    count = tasks or int(listing.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def rows_of(batch: pa.RecordBatch) -> Iterator[dict]:
        columns = [batch.column(n).to_pylist() for n in ("root_path", "rel_path", "start", "length")]
        for root, path, start, length in zip(*columns):
            yield _piece(os.path.join(root, path), start, length)

    plain = listing.where("readable and not is_symlink").select("root_id", "root_path", "rel_path", "size")
    # in the order of the file within a task, so that a disk reads on
    dealt = pieces_of(plain, F.col("size"), piece).drop("size").repartitionByRange(count, "root_id", "rel_path", "piece")
    return dealt.mapInArrow(_arrow_job(rows_of, _arrow_schema(schema)), schema)


def piece_digests_of_bytes(table: DataFrame, data: Column, piece: int = PIECE_SIZE) -> DataFrame:
    """The same where the bytes are a column: the other columns, with `piece, start, length, piece_digest`."""
    sized = table.withColumns({"_data": data, "_size": F.octet_length(data).cast("long")})
    part = F.substring(F.col("_data"), (F.col("start") + 1).cast("int"), F.col("length").cast("int"))
    cut_up = pieces_of(sized, F.col("_size"), piece).withColumn("piece_digest", F.sha2(F.concat(F.lit(_LEAF), part), 256))
    return cut_up.drop("_data", "_size")


def root_digests(pieces: DataFrame, key: list[str], fan_out: int = FAN_OUT) -> DataFrame:
    """The root of each file's digest tree: `key, pieces, root_digest`, from `piece, piece_digest`.

    A parent is the digest of its children's digests, at most `fan_out` of them, in order; a single digest is
    the root. So a level is one aggregation over (file, parent), and no file's pieces meet in one task until
    they are few. A file with an unread piece has a null root.
    """
    sizes = pieces.groupBy(*key).agg(F.count(F.lit(1)).alias("pieces"), F.bool_or(F.col("piece_digest").isNull()).alias("torn"))
    sizes = written(sizes)
    most = sizes.agg(F.max("pieces")).first()[0] or 0
    level = pieces.select(*key, "piece", F.coalesce("piece_digest", F.lit("")).alias("digest"))
    while most > 1:
        order = F.array_sort(F.collect_list(F.struct("piece", "digest")))  # `fan_out` at most
        joined = F.array_join(F.transform("children", lambda c: c["digest"]), "")
        parent = F.sha2(F.concat(F.lit(_NODE), F.unhex(joined)), 256)
        # an only child on the first place is a root already; one elsewhere has siblings in the next level
        alone = (F.size("children") == 1) & (F.col("parent") == 0) & (F.col("children")[0]["piece"] == 0)
        level = (
            level.groupBy(*key, F.floor(F.col("piece") / fan_out).alias("parent")).agg(order.alias("children"))
            .select(*key, F.col("parent").alias("piece"), F.when(alone, F.col("children")[0]["digest"]).otherwise(parent).alias("digest"))
        )
        most = -(-most // fan_out)
    return sizes.join(level.drop("piece"), key).select(*key, "pieces", F.when(~F.col("torn"), F.col("digest")).alias("root_digest"))


def broken_ranges(again: DataFrame, stored: DataFrame, key: list[str]) -> DataFrame:
    """Byte ranges that no longer have their stored digest: `key, start, end` (exclusive), `pieces`, `verdict`.

    `stored` and `again` have `key, piece, start, length, piece_digest` of the same piece size. Neighbouring ranges
    of one verdict are one: `different`, `unreadable`, `missing` (the file is shorter now), `added`.
    """
    old = stored.select(*key, "piece", F.struct("start", "length", F.col("piece_digest").alias("digest")).alias("old"))
    new = again.select(*key, "piece", F.struct("start", "length", F.col("piece_digest").alias("digest")).alias("new"))
    verdict = (
        F.when(F.col("new").isNull(), "missing").when(F.col("old").isNull(), "added")
        .when(F.col("new.digest").isNull(), "unreadable")
        .when(~F.col("new.digest").eqNullSafe(F.col("old.digest")), "different")
    )
    broken = written(
        old.join(new, [*key, "piece"], "full").withColumn("verdict", verdict).where("verdict is not null")
        .withColumn("at", F.coalesce("new", "old"))
        .select(*key, "piece", "verdict", F.col("at.start").alias("start"), (F.col("at.start") + F.col("at.length")).alias("end"))
    )
    # pieces that follow one another differ from their rank by the same number
    of_kind = Window.partitionBy(*key, "verdict").orderBy("piece")
    runs = broken.withColumn("run", F.col("piece") - F.row_number().over(of_kind))
    return runs.groupBy(*key, "verdict", "run").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.count(F.lit(1)).alias("pieces")
    ).drop("run")


def verify_pieces(chosen: DataFrame, stored: DataFrame, piece: int = PIECE_SIZE, tasks: int | None = None) -> DataFrame:
    """Reads the chosen files (a listing) again, range by range and many tasks a file, and names the byte ranges that
    differ from `stored`, the `piece_digests` of an earlier read: see `broken_ranges`."""
    key = ["root_id", "rel_path"]
    asked = chosen.join(stored.select(*key).distinct(), key, "left_semi")
    again = piece_digests(asked, piece, tasks)
    return broken_ranges(again, stored.join(asked.select(*key), key, "left_semi"), key)


def deal_by_size(listing: DataFrame, tasks: int | None = None) -> DataFrame:
    """Rows in exactly `tasks` partitions (by default as many as there are shuffle partitions).

    Rows are sorted by size and dealt in turn, so that the largest files go to different tasks and all
    tasks get much the same bytes. An explicit number is needed: adaptive execution would merge the
    partitions by the bytes of the listing, which is tiny beside the files it names.
    """
    count = tasks or int(listing.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.desc_nulls_last("size"), "root_id", "rel_path"]
    ordered = listing.repartitionByRange(count, *order).sortWithinPartitions(*order)
    turn = F.pmod(
        F.monotonically_increasing_id() % F.lit(1 << 33) + F.spark_partition_id() * 7, F.lit(count)
    ).cast("int")
    return ordered.withColumn("turn", turn).repartitionById(count, "turn").drop("turn")


def header_facts_of_bytes(
    table: DataFrame, content: str, path: str, active_key: str = ""
) -> DataFrame:
    """Header facts where the file's first bytes are a column of a table."""
    options = {"active_key": active_key}
    kept = [c for c in table.columns if c != content]
    schema = StructType([f for f in table.schema.fields if f.name != content] + _RAW.fields)

    def rows_of(batch: pa.RecordBatch) -> Iterator[dict]:
        for data, name in zip(batch.column(content).to_pylist(), batch.column(path).to_pylist()):
            yield _header_facts(io.BytesIO(data or b""), name, options)

    job = _arrow_job(rows_of, _arrow_schema(schema))
    return _finish(table.mapInArrow(job, schema), kept).drop("sha256", "partial_digest", "hash_error")


def digests_of_bytes(data: Column, window: int = PARTIAL_WINDOW) -> tuple[Column, Column]:
    """Full and partial digest where the bytes are a column; plain expressions, no Python."""
    size = F.octet_length(data)
    edges = F.concat(
        F.substring(data, F.lit(1), F.lit(window)),
        F.substring(data, size - (window - 1), F.lit(window)),
    )
    full = F.sha2(data, 256)
    return full, F.when(size > 2 * window, F.sha2(edges, 256)).otherwise(full)


def _safetensors_columns(header: Column) -> dict[str, Column]:
    """Architecture and parameter count from a safetensors header, as JVM expressions.

    Every tensor counts the product of its shape, an empty shape counts one, and entries of a shape
    that are not whole numbers count nothing. A file with no metadata and no tensors has no facts.
    """
    doc = F.try_parse_json(header)
    arch_at = "$.__metadata__.architectures"

    def text_at(path: str) -> Column:
        found = F.try_variant_get(doc, path, "variant")
        is_text = F.schema_of_variant(found) == "STRING"
        return F.when(is_text, F.try_variant_get(doc, path, "string"))

    entries = F.map_filter(
        F.from_json(header, "map<string,string>"), lambda name, _: name != "__metadata__"
    )
    shapes = F.filter(
        F.transform(F.map_values(entries), lambda v: F.get_json_object(v, "$.shape")),
        lambda s: s.startswith("["),
    )

    def product(shape: Column) -> Column:
        sizes = F.transform(
            F.from_json(shape, "array<string>"), lambda d: F.when(d.rlike(r"\A[0-9]+\z"), d.try_cast("double"))
        )
        return F.aggregate(sizes, F.lit(1.0), lambda acc, d: acc * F.coalesce(d, F.lit(1.0)))

    total = F.aggregate(F.transform(shapes, product), F.lit(0.0), lambda acc, n: acc + n)
    finite = (total > 0) & (total < float("inf"))
    return {
        "broken": header.isNotNull() & doc.isNull(),
        "arch": F.coalesce(text_at(arch_at), text_at(arch_at + "[0]")),
        "params_total": F.when(finite, total),
    }


def _finish(found: DataFrame, kept: list[str]) -> DataFrame:
    """Completes raw rows to `schemas.HEADER_FACTS`."""
    is_text = F.col("format") == "safetensors"
    parts = _safetensors_columns(F.col("safetensors_header"))
    typed = found.withColumns({f"st_{n}": c for n, c in parts.items()})
    arch = F.when(is_text, F.col("st_arch")).otherwise(F.col("arch"))
    named_only = F.col("format").isin("onnx", "pytorch")
    kind = (
        F.when(is_text, kind_of_safetensors(arch))
        .when(F.col("format") == "gguf", kind_of_gguf(arch))
        .when(named_only, field(F.lit("unknown"), "detected"))
    )
    columns = {
        "arch": arch,
        "params_total": F.when(is_text, F.col("st_params_total")).otherwise(F.col("params_total")),
        "quant_from_header": quant_of_file_type(F.col("file_type")),
        "kind": kind,
        "parse_error": F.coalesce(
            "parse_error",
            F.when(F.col("st_broken"), "safetensors.bad_json"),
            F.when(F.col("format") == "unknown", "unsupported"),
        ),
    }
    return typed.select(
        *kept,
        *[columns.get(n, F.col(n)).alias(n) for n in schemas.HEADER_FACTS.names],
        "sha256", "partial_digest", "hash_error",
    )


def verify_digests(chosen: DataFrame, stored: DataFrame) -> DataFrame:
    """Reads the chosen files again and compares with the stored digests (`verdict`).

    `chosen` is a listing; `stored` has `root_id, rel_path, sha256` of fully hashed files.
    """
    key = ["root_id", "rel_path"]
    wanted = stored.where(F.col("sha256").isNotNull()).select(
        *key, F.col("sha256").alias("stored_sha256")
    )
    asked = chosen.join(wanted.select(*key), key, "left_semi")
    again = examine_files(asked, digests=True, headers=False).select(*key, "sha256")
    verdict = (
        F.when(F.col("sha256").isNull(), "unreadable")
        .when(F.col("sha256") == F.col("stored_sha256"), "same")
        .otherwise("different")
    )
    return again.join(wanted, key).select(*key, "stored_sha256", "sha256", verdict.alias("verdict"))
