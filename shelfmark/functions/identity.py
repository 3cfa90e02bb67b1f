"""Family keys, truth levels and the projection that identifies one file per row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark.functions import names

# ---- fixed values ---------------------------------------------------------------------------
# `general.file_type` numbers of GGUF headers; 5, 6 and everything above 32 have no tag.
FILE_TYPE_QUANTS = {
    0: "F32", 1: "F16", 2: "Q4_0", 3: "Q4_1", 4: "Q4_1_SOME_F16",
    7: "Q8_0", 8: "Q5_0", 9: "Q5_1",
    10: "Q2_K", 11: "Q3_K_S", 12: "Q3_K_M", 13: "Q3_K_L",
    14: "Q4_K_S", 15: "Q4_K_M", 16: "Q5_K_S", 17: "Q5_K_M", 18: "Q6_K",
    19: "IQ2_XXS", 20: "IQ2_XS", 21: "Q2_K_S", 22: "IQ3_XS", 23: "IQ3_XXS",
    24: "IQ1_S", 25: "IQ4_NL", 26: "IQ3_S", 27: "IQ3_M", 28: "IQ2_S", 29: "IQ2_M",
    30: "IQ4_XS", 31: "IQ1_M", 32: "BF16",
}
# Where a fact of a given truth level comes from.
LEVEL_SOURCES = {
    "known": "content",
    "detected": "structure",
    "inferred": "filename",
    "external": "external",
    "manual": "user",
}
VISION_MARKS = ("clip", "vision")
TEXT_MODEL_MARKS = ("causallm", "llama", "qwen", "mistral", "gemma", "phi", "gpt")
# ---- end of fixed values --------------------------------------------------------------------

MODEL_ROLES = ("weights", "shard")
COMPANION_ROLES = ("mmproj", "lora", "tokenizer", "config", "sidecar")

FIELD = "struct<value:string,level:string>"
_BIGGEST_LONG = 9223372036854775807


def _literal_map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])


def quant_of_file_type(file_type: Column) -> Column:
    return _literal_map(FILE_TYPE_QUANTS)[file_type.cast("int")]


def file_type_of_quant(quant: Column) -> Column:
    return _literal_map({q: n for n, q in FILE_TYPE_QUANTS.items()})[quant]


def level_source(level: Column) -> Column:
    return _literal_map(LEVEL_SOURCES)[level]


def field(value: Column, level: Column | str) -> Column:
    """`{value, level}`, or null when there is no value."""
    level = F.lit(level) if isinstance(level, str) else level
    return F.when(value.isNotNull(), F.struct(value.alias("value"), level.alias("level")))


def _pair(value: Column, level: Column) -> Column:
    """`{value, level}` of a value that is always there."""
    return F.struct(value.alias("value"), level.alias("level"))


def round1(v: Column) -> Column:
    """One decimal, halves away from zero, whole numbers without the decimal."""
    r = F.round(v * 10, 0) / 10
    limit = F.when(r > 0, F.lit(_BIGGEST_LONG)).otherwise(F.lit(-_BIGGEST_LONG - 1))
    whole = F.coalesce(r.try_cast("long"), limit)
    # format_string writes a text for null, so it is asked only for numbers with a fraction.
    return F.when(r == F.rint(r), whole.cast("string")).when(
        r != F.rint(r), F.format_string("%.1f", r)
    )


def params_identity(total: Column, active: Column) -> Column:
    return F.concat(
        F.lit("t"), F.coalesce(round1(total), F.lit("unk")),
        F.lit("|a"), F.coalesce(round1(active), F.lit("unk")),
    )


def family_key(name: Column, arch: Column, total: Column, active: Column) -> Column:
    return F.concat_ws(
        "|", names.slug(name), F.coalesce(arch, F.lit("unk")), params_identity(total, active)
    )


def kind_of_gguf(arch: Column) -> Column:
    kind = F.when(names.contains_any(arch, VISION_MARKS), "vision").otherwise("llm")
    return field(F.when(arch.isNotNull(), kind), "known")


def kind_of_safetensors(arch: Column) -> Column:
    low = F.lower(arch)
    kind = F.when(names.contains_any(low, VISION_MARKS), "vision").when(
        names.contains_any(low, TEXT_MODEL_MARKS), "llm"
    )
    return field(kind, "inferred")


def with_name_facts(files: DataFrame, path: str = "rel_path") -> DataFrame:
    """Adds everything the file name alone says, one `name_*` column per fact."""
    named = files.withColumn("name_stem", names.stem(path))
    return named.withColumns(
        {
            "name_role": names.role("name_stem"),
            "name_quant": names.quant_tag("name_stem"),
            "name_publisher": names.publisher("name_stem"),
            "name_subflavour": names.subflavour("name_stem"),
            "name_kind": names.kind_from_name("name_stem"),
            "name_display": names.display_stem("name_stem"),
        }
    )


def with_identity(facts: DataFrame) -> DataFrame:
    """Resolves every identity field of each file and its truth level.

    `facts` holds `rel_path` and the header facts (`schemas.HEADER_FACTS`). Header beats name. A
    shard is always named after its file name and leaves the parameter counts out of its key, since
    one shard never holds the whole model. Adds `role, name, arch, params_total, params_active,
    context_len, kind, quant, quant_raw, subflavour, publisher` (all but `role` as
    `{value, level}`), `is_unknown` and `family_key`, and drops the raw facts they replace.
    """
    shard = F.col("name_role") == "shard"
    header_name = F.coalesce(F.col("basename"), F.col("general_name"))
    has_facts = header_name.isNotNull() | F.col("arch").isNotNull() | F.col("params_total").isNotNull()
    by_stem = shard | header_name.isNull()
    header_quant = F.col("quant_from_header")
    resolved = with_name_facts(facts).withColumns(
        {
            "role": F.col("name_role"),
            "name": _pair(
                F.when(by_stem, F.col("name_display")).otherwise(header_name),
                F.when(by_stem, "inferred").otherwise("known"),
            ),
            "quant": _pair(
                F.coalesce(header_quant, "name_quant", F.lit("unknown")),
                F.when(header_quant.isNotNull(), "known").otherwise("inferred"),
            ),
            "quant_raw": field(
                F.coalesce(F.col("file_type").cast("string"), "name_quant"),
                F.when(F.col("file_type").isNotNull(), "known").otherwise("inferred"),
            ),
            "kind": _pair(
                F.coalesce("kind.value", "name_kind", F.lit("unknown")),
                F.when(F.col("kind").isNotNull(), F.col("kind.level"))
                .when(F.col("name_kind").isNotNull(), "inferred")
                .otherwise("detected"),
            ),
            "subflavour": _pair(F.coalesce("name_subflavour", F.lit("unknown")), F.lit("inferred")),
            "publisher": _pair(F.coalesce("name_publisher", F.lit("unknown")), F.lit("inferred")),
            "is_unknown": ~has_facts
            & F.col("name_role").isin(*MODEL_ROLES)
            & F.col("name_quant").isNull(),
        }
    )
    key_total = F.when(~shard, F.col("params_total"))
    key_active = F.when(~shard, F.col("params_active"))
    keyed = resolved.withColumn(
        "family_key",
        F.when(
            ~F.col("is_unknown"),
            family_key(F.col("name.value"), F.col("arch"), key_total, key_active),
        ),
    )
    return keyed.withColumns(
        {
            "arch": field(F.col("arch"), "known"),
            "params_total": field(F.col("params_total"), "known"),
            "params_active": field(F.col("params_active"), "known"),
            "context_len": field(F.col("context_len"), "known"),
        }
    ).drop(
        "name_stem", "name_role", "name_quant", "name_publisher", "name_subflavour", "name_kind",
        "name_display", "general_name", "basename", "finetune", "file_type", "quant_from_header",
    )
