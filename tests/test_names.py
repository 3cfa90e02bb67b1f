"""Golden rows for what a file name says, and for the identity of single files."""

import pytest
from pyspark.sql import functions as F

from shelfmark.functions import identity, names

GOLDEN = """
DeepSeek-R1-Distill-Qwen-32B-Q4_K_M.gguf weights Q4_K_M deepseek-r1-distill-qwen-32b
DeepSeek-R1-Distill-Qwen-32B-Q5_K_M.gguf weights Q5_K_M deepseek-r1-distill-qwen-32b
Qwen3-Coder-30B-A3B-Instruct-UD-Q4_K_XL.gguf weights Q4_K_XL qwen3-coder-30b-instruct
Qwen3-Coder-30B-A3B-Instruct-UD-Q6_K_XL.gguf weights Q6_K_XL qwen3-coder-30b-instruct
Qwen3.6-27B-UD-Q4_K_XL.gguf weights Q4_K_XL qwen3-6-27b
gpt-oss-120b-UD-Q4_K_XL-00001-of-00002.gguf shard Q4_K_XL gpt-oss-120b
Qwen3.8-27B-Uncensored-HauhauCS-Aggressive-Q4_K_P.gguf weights unknown qwen3-8-27b-uncensored-hauhaucs-aggressive-q4-k-p
Qwen3.8-27B-Uncensored-HauhauCS-Aggressive-FastMTP-32K.gguf sidecar unknown qwen3-8-27b-uncensored-hauhaucs-aggressive-fastmtp-32k
mmproj-Qwen3.8-27B-Uncensored-HauhauCS-Aggressive-BF16.gguf mmproj BF16 mmproj-qwen3-8-27b-uncensored-hauhaucs-aggressive
Qwen3.8-27B-Q4_K_M.gguf weights Q4_K_M qwen3-8-27b
Qwen3.6-35B-A3B-UD-Q4_K_XL.gguf weights Q4_K_XL qwen3-6-35b-ud
Qwen3.5-35B-A3B-UD-Q4_K_XL.gguf weights Q4_K_XL qwen3-5-35b-ud
Devstral-Small-2-24B-Instruct-2512-UD-Q4_K_XL.gguf weights Q4_K_XL devstral-small-2-24b-instruct-2512
gemma-4-26B-A4B-it-UD-Q4_K_XL.gguf weights Q4_K_XL gemma-4-26b-it
bge-reranker-v2-m3-Q8_0.gguf weights Q8_0 bge-reranker-v2-m3
nomic-embed-text-v1.5.Q8_0.gguf weights Q8_0 nomic-embed-text-v1-5
mmproj-F16.gguf mmproj F16 mmproj
random.safetensors weights unknown random
qwen3-coder-q4.gguf weights unknown qwen3-coder-q4
Qwen3-Coder-30B-Q8.gguf weights unknown qwen3-coder-30b-q8
qwen3-coder-30b-q4_k_m-bartowski.gguf weights Q4_K_M qwen3-coder-30b
""".split("\n")[1:-1]
# One tag inside another, several tags, and none.
OVERLAPS = {
    "x-IQ4_K_M": "Q4_K_M", "x-Q2_K_S": "Q2_K_S", "x-Q2_K": "Q2_K", "x-BF16": "BF16", "x-F16": "F16",
    "F16-then-Q4_0": "Q4_0", "F32-F16-BF16": "BF16", "Q2_K-Q6_K_XL": "Q6_K_XL", "iq3_m-Q5_K_M": "Q5_K_M",
    "Q4_0-and-q8_k": "Q8_K", "a\nIQ1_S": "IQ1_S", "plain": None, "Q4_K_P": None,
}
ROLES = {
    "a/config.json": "config", "config.gguf": "config", "model_index.json": "config", "my-config": "weights",
    "tokenizer.json": "tokenizer", "vocab.txt": "tokenizer", "x.lora.gguf": "lora", "x-lora-1.gguf": "lora",
    "mmproj-lora.gguf": "mmproj", "x-vision_projector.gguf": "mmproj", "x-1-of-2-tail.gguf": "shard",
    "x-1-OF-2.gguf": "weights", "x-123456-of-2.gguf": "weights", "m-draft.gguf": "sidecar",
    "m-mtp-1.gguf": "sidecar", "speculative.gguf": "sidecar", "lora.gguf": "weights",
}


def one_column(spark, texts, column):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    return [r.x for r in df.select("i", column.alias("x")).orderBy("i").collect()]


def test_golden_names(spark):
    rows = [line.split() for line in GOLDEN]
    df = identity.with_name_facts(spark.createDataFrame([(r[0],) for r in rows], "rel_path string"))
    found = {r.rel_path: (r.name_role, r.name_quant or "unknown", r.name_display) for r in df.collect()}
    assert found == {r[0]: tuple(r[1:]) for r in rows}


def test_overlapping_tags(spark):
    assert one_column(spark, OVERLAPS, names.quant_tag("t")) == list(OVERLAPS.values())


def test_ordered_match_equals_a_plain_loop(spark):
    texts = [f"{a}-{b}" for a in names.QUANT_TAGS for b in names.QUANT_TAGS]
    texts += [f"{a}{b}"[cut:] for a in names.QUANT_TAGS for b in names.QUANT_TAGS[::3] for cut in (1, 2)]
    wanted = [next((q for q in names.QUANT_TAGS if q in t), None) for t in texts]
    assert one_column(spark, texts, names.quant_tag("t")) == wanted
    words = [f"{a}{b}" for a in names.SUBFLAVOURS for b in ("", *names.SUBFLAVOURS)]
    wanted = [next((s for s in names.SUBFLAVOURS if s in t), None) for t in words]
    assert one_column(spark, words, names.subflavour("t")) == wanted


def test_stems(spark):
    files = {"d/x.gguf": "x", "x.safetensors.gguf": "x", "x.gguf.safetensors": "x.gguf", "x.GGUF": "x.GGUF",
             ".gguf": "", "x.gguf.gguf": "x.gguf", "a/b.bin": "b.bin", "x.safetensors": "x"}
    assert one_column(spark, files, names.stem("t")) == list(files.values())


def test_roles(spark):
    assert one_column(spark, ROLES, names.role(names.stem("t"))) == list(ROLES.values())


@pytest.mark.parametrize("value, text", [
    (30.5, "30.5"), (30.25, "30.3"), (0.05, "0.1"), (8.0, "8"), (-2.25, "-2.3"), (0.04, "0"),
    (1e300, "9223372036854775807"), (16384.0, "16384"), (None, None), (12345678.9, "12345678.9"),
])
def test_round1(spark, value, text):
    df = spark.createDataFrame([(value,)], "v double")
    assert df.select(identity.round1(F.col("v")).alias("x")).first().x == text


def test_similarity(spark):
    pairs = [("qwen3-30b-a3b|qwen3|t30.5|a3.0", "qwen3-32b|qwen3|t32|a32", 1, 0.5),
             ("foo-8b-instruct|qwen3|t8.0|a8.0", "bar-8b-instruct|qwen3|t8.0|a8.0", 0, 0.0),
             ("a-a-b|x|t|a", "a-c-c|x|t|a", 2, 0.4), ("base|x|t|a", "base|x|t|a", 0, None)]
    df = spark.createDataFrame([p[:2] for p in pairs], "a string, b string")
    a, b = names.name_tokens("a"), names.name_tokens("b")
    rows = df.select(names.shared_tokens(a, b), names.similarity_score(a, b)).collect()
    assert [tuple(r) for r in rows] == [p[2:] for p in pairs]


def test_partial_and_trusted_names(spark):
    files = ["a.gguf.part", "a.aria2", "a.!qB", "a.crdownload", "a.part_file", "a.party", "part"]
    assert one_column(spark, files, names.is_partial_download("t")) == [True] * 5 + [False] * 2
    digest = "0a" * 32
    blobs = [f"b/sha256-{digest}", f"sha256-{digest}", f"xsha256-{digest}", f"sha256-{digest}0"]
    assert one_column(spark, blobs, names.digest_in_name("t")) == [digest, digest, None, None]
