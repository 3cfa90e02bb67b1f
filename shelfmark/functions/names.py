"""What a model file's name says: role, quantisation, publisher, display stem.

Every helper takes a column (or a column name) and returns a column. Digits are ASCII digits and
patterns that mean "end of text" use ``\\z``, because ``$`` also matches before a final newline.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values ---------------------------------------------------------------------------
# Quantisation tags. The order carries meaning: the first tag contained in the name is the answer.
QUANT_TAGS = (
    "Q8_K",
    "Q6_K_XL", "Q5_K_XL", "Q4_K_XL", "Q3_K_XL",
    "Q5_K_M", "Q4_K_M", "Q5_K_S", "Q4_K_S", "Q4_K_L", "Q5_K_L",
    "Q3_K_M", "Q3_K_S", "Q3_K_L",
    "Q2_K_S", "Q2_K", "Q6_K",
    "IQ3_XXS", "IQ3_XS", "IQ2_XXS",
    "IQ4_NL", "IQ4_XS",
    "IQ1_M", "IQ1_S",
    "IQ2_M", "IQ2_S", "IQ2_XS",
    "IQ3_M", "IQ3_S",
    "Q8_0", "Q5_1", "Q5_0", "Q4_1", "Q4_0",
    "BF16", "F16", "F32",
)
PUBLISHERS = ("bartowski", "mradermacher", "TheBloke", "turboderp", "Orenguteng")
SUBFLAVOURS = ("instruct", "chat", "base", "thinking", "coder", "reasoning", "reasoner")
# Parts of a name that decide the role, in the order they are asked.
MMPROJ_MARKS = ("mmproj", "vision_projector")
TOKENIZER_MARKS = ("tokenizer", "vocab")
CONFIG_STEMS = ("config", "config.json", "model_index.json")
SIDECAR_MARKS = ("fastmtp", "-mtp-", "-draft", "speculative")
# Parts of a name that decide the kind, in the order they are asked.
RERANK_MARKS = ("rerank",)
EMBEDDING_MARKS = ("nomic-embed", "-embed", "text-embedding")
AUDIO_MARKS = ("whisper", "stt", "-tts")
# Name tokens that say nothing about which model it is.
STOP_TOKENS = (
    "q2", "q3", "q4", "q5", "q6", "q8", "iq1", "iq2", "iq3", "iq4",
    "k", "s", "m", "l", "xl", "xxs", "xs", "f16", "f32", "bf16",
    "instruct", "chat", "base", "thinking", "unknown",
)
SHARD_PATTERN = r"-[0-9]{1,5}-of-[0-9]{1,5}(?:-[^/]*)?\z"
FLAVOUR_PATTERN = r"(^|[^a-z0-9])(?:ud|a[0-9]+b)(\z|[^a-z0-9])"
SIZE_TOKEN_PATTERN = r"\A[0-9]+\.?[0-9]*b\z"
PARAMS_PATTERN = r"(?i)([0-9]+(?:\.[0-9]+)?)\s*b\b"
# Endings of unfinished downloads.
PARTIAL_SUFFIXES = (".part", ".part_file", ".aria2", ".!qb", ".crdownload")
# Name of a blob file whose name is its own SHA-256.
DIGEST_NAME_PATTERN = r"(?:^|/)sha256-([0-9a-f]{64})\z"
# ---- end of fixed values --------------------------------------------------------------------


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def contains_any(text: Column, marks: Iterable[str]) -> Column:
    found = F.lit(False)
    for mark in marks:
        found = found | text.contains(mark)
    return found


def first_contained(text: Column, values: Iterable[str]) -> Column:
    """First of `values`, in their order, that `text` contains, else null.

    One pattern instead of one test per value keeps the generated code small. A text that holds at
    most one of the values, the common case, is answered by the leftmost match; this needs that of
    two values starting at one place the longer is listed first, and that no value starts inside
    another one listed after it. Only a text with several values is searched value by value: each
    alternative moves to the first place of its value, and the group takes what stands there.
    """
    escaped = [re.escape(value) for value in values]
    starts = "".join(sorted({re.escape(value[0]) for value in values}))
    one = rf"(?=[{starts}])({'|'.join(escaped)})"
    moves = "|".join(f".*?(?={value})" for value in escaped)
    several = text.rlike(rf"(?s){one}.*?{one}")
    by_order = F.regexp_extract(text, rf"(?s)\A(?:{moves})({'|'.join(escaped)})", 1)
    leftmost = F.regexp_extract(text, one, 1)
    return F.nullif(F.when(several, by_order).otherwise(leftmost), F.lit(""))


def base_name(path: Column | str) -> Column:
    return F.substring_index(F.rtrim(_col(path), F.lit("/")), "/", -1)


def stem(path: Column | str) -> Column:
    """Last part of the path without ``.gguf`` and then without ``.safetensors``."""
    return F.regexp_replace(base_name(path), r"(?:\.safetensors)?(?:\.gguf)?\z", "")


def is_shard(stem_col: Column | str) -> Column:
    # The plain test spares most names the pattern.
    return _col(stem_col).contains("-of-") & _col(stem_col).rlike(SHARD_PATTERN)


def unsharded(stem_col: Column | str) -> Column:
    """The stem without its shard suffix; the stem itself when it has none."""
    name = _col(stem_col)
    stripped = F.regexp_replace(name, SHARD_PATTERN, "")
    return F.when(name.contains("-of-"), stripped).otherwise(name)


def shard_strip(stem_col: Column | str) -> Column:
    """The stem without its shard suffix; null when it has none."""
    return F.when(is_shard(stem_col), unsharded(stem_col))


def role(stem_col: Column | str) -> Column:
    name = _col(stem_col)
    low = F.lower(name)
    return (
        F.when(contains_any(low, MMPROJ_MARKS), "mmproj")
        .when(contains_any(low, TOKENIZER_MARKS), "tokenizer")
        .when(low.isin(*CONFIG_STEMS), "config")
        .when(low.rlike(r"\.lora\z|-lora"), "lora")
        .when(is_shard(name), "shard")
        .when(contains_any(low, SIDECAR_MARKS), "sidecar")
        .otherwise("weights")
    )


def quant_tag(stem_col: Column | str) -> Column:
    return first_contained(F.upper(_col(stem_col)), QUANT_TAGS)


def publisher(stem_col: Column | str) -> Column:
    spelled = F.create_map(*[F.lit(x) for name in PUBLISHERS for x in (name.lower(), name)])
    return spelled[first_contained(F.lower(_col(stem_col)), [p.lower() for p in PUBLISHERS])]


def subflavour(stem_col: Column | str) -> Column:
    return first_contained(F.lower(_col(stem_col)), SUBFLAVOURS)


def kind_from_name(stem_col: Column | str) -> Column:
    low = F.lower(_col(stem_col))
    return (
        F.when(contains_any(low, RERANK_MARKS), "rerank")
        .when(contains_any(low, EMBEDDING_MARKS), "embeddings")
        .when(contains_any(low, AUDIO_MARKS), "audio")
    )


def params_tag(stem_col: Column | str) -> Column:
    """Size in billions as written in the name, e.g. 30 for ``30B``. Never part of an identity."""
    return F.regexp_extract(_col(stem_col), PARAMS_PATTERN, 1).try_cast("double")


def slug(text: Column | str) -> Column:
    return F.btrim(F.regexp_replace(F.lower(_col(text)), "[^a-z0-9]+", "-"), F.lit("-"))


def display_stem(stem_col: Column | str) -> Column:
    """Slug of the stem without shard suffix, quantisation tag, publisher and flavour tokens.

    The flavour tokens are replaced without overlap, so of two neighbours the second one stays.
    """
    text = F.lower(unsharded(stem_col))
    text = F.replace(text, F.coalesce(F.lower(quant_tag(text)), F.lit("\0")), F.lit(""))
    for name in PUBLISHERS:
        text = F.replace(text, F.lit(name.lower()), F.lit(""))
    return slug(F.regexp_replace(text, FLAVOUR_PATTERN, "-"))


def is_partial_download(path: Column | str) -> Column:
    endings = "|".join(re.escape(suffix) for suffix in PARTIAL_SUFFIXES)
    return F.lower(_col(path)).rlike(rf"(?:{endings})\z")


def digest_in_name(path: Column | str) -> Column:
    """SHA-256 that a content-addressed store put into the file name, else null."""
    return F.nullif(F.regexp_extract(_col(path), DIGEST_NAME_PATTERN, 1), F.lit(""))


def name_tokens(family_key: Column | str) -> Column:
    parts = F.split(F.lower(F.substring_index(_col(family_key), "|", 1)), "-")
    return F.filter(
        parts,
        lambda t: (t != "") & ~t.isin(*STOP_TOKENS) & ~t.rlike(SIZE_TOKEN_PATTERN),
    )


def shared_tokens(a: Column, b: Column) -> Column:
    """How many tokens of `a` occur in `b`; a token repeated in `a` counts each time."""
    return F.size(F.filter(a, lambda t: F.array_contains(b, t))).cast("long")


def similarity_score(a: Column, b: Column) -> Column:
    """Shared tokens over all tokens, both counted with repeats; null when there are none."""
    only_b = F.size(F.filter(b, lambda t: ~F.array_contains(a, t)))
    return F.try_divide(
        shared_tokens(a, b).cast("double"), (F.size(a) + only_b).cast("double")
    )
