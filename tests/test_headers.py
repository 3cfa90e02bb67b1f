"""Header facts: what is read, and that a bad file becomes a value and never an error."""

import hashlib
import struct

import pytest
from pyspark.sql import functions as F

from shelfmark import schemas
from shelfmark.sources import contents, gguf
from tests import payloads as p


def array(item: int, count: int, body: bytes = b"") -> bytes:
    return struct.pack("<IQ", item, count) + body


def nested(depth: int) -> bytes:
    return array(9, 1) * depth + array(4, 0)


BAD = {
    "gguf.magic": b"GGUX" + bytes(20),
    "gguf.unsupported_version": p.gguf(version=1),
    "gguf.truncated": p.model(basename="x")[:-1],
    "gguf.array_too_deep": p.gguf([("k", 9, nested(5000))]),
    "gguf.bad_tag": p.gguf([("k", 13, b"")]),
    "gguf.bad_utf8": p.gguf([("k", 8, struct.pack("<Q", 1) + b"\xff")]),
    "gguf.params_not_finite": p.gguf(tensors=[[1 << 63] * 20]),
}
LIMITED = {
    "gguf.string_too_long": (p.gguf([("k", 8, p.text("x" * 99))]), {"max_string": 98}),
    "gguf.array_too_large": (p.gguf([("k", 9, array(0, 99, bytes(99)))]), {"max_array": 98}),
    "gguf.array_too_deep": (p.gguf([("k", 9, nested(6))]), {"max_nesting": 4}),
}
LYING = [
    p.gguf([("k", 8, struct.pack("<Q", 1 << 62))]), p.gguf([("k", 9, array(4, 1 << 62))]),
    p.gguf([("k", 9, array(8, 1 << 62, bytes(64)))]), p.gguf([("k", 9, array(9, 1 << 62))]),
]


@pytest.mark.parametrize("code", BAD)
def test_bad_gguf(code):
    with pytest.raises(gguf.HeaderError, match=code.replace(".", r"\.")):
        gguf.read_facts(BAD[code])


@pytest.mark.parametrize("code", LIMITED)
def test_limits_are_options(code):
    data, limit = LIMITED[code]
    gguf.read_facts(data)
    with pytest.raises(gguf.HeaderError, match=code.replace(".", r"\.")):
        gguf.read_facts(data, **limit)


@pytest.mark.parametrize("data", LYING)
def test_lengths_beyond_the_file(data):
    with pytest.raises(gguf.HeaderError, match="truncated"):
        gguf.read_facts(data)


def vocabulary(n=150_000):
    words = b"".join(p.text(f"token{i}") for i in range(n))
    pairs = [("tokenizer.ggml.tokens", 9, array(8, n, words)), ("scores", 9, array(6, n, bytes(4 * n))),
             ("general.basename", 8, p.text("Large Vocabulary")), ("general.architecture", 8, p.text("qwen3"))]
    return p.gguf(pairs, [(7, 3)])


def test_large_vocabulary_and_long_headers(spark, tmp_path):
    """Headers beyond a megabyte (and, for safetensors, beyond eight) are read to their end."""
    data = vocabulary()
    assert len(data) > 2 << 20
    long = p.safetensors({"__metadata__": {"architectures": "LlamaForCausalLM", "pad": "x" * (9 << 20)}, "a": {"shape": [6]}})
    p.write(tmp_path, {"v.gguf": data, "long.safetensors": long})
    rows = {r.rel_path: r for r in contents.examine_files(listing_of(spark, tmp_path, ["v.gguf", "long.safetensors"])).collect()}
    assert (rows["v.gguf"].basename, rows["v.gguf"].params_total, rows["v.gguf"].parse_error) == ("Large Vocabulary", 21.0, None)
    assert (rows["long.safetensors"].arch, rows["long.safetensors"].params_total) == ("LlamaForCausalLM", 6.0)


def test_files_are_dealt_to_all_tasks_by_size(spark):
    """20,000 listed files in as many tasks as there are shuffle partitions, the large ones apart."""
    size = F.when(F.col("id") < 8, F.lit(1 << 40)).otherwise(F.col("id"))
    files = spark.range(0, 20_000, 1, 3).select(
        F.lit(1).cast("long").alias("root_id"), F.concat(F.lit("f"), "id").alias("rel_path"), size.alias("size"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        at = contents.deal_by_size(files).groupBy(F.spark_partition_id().alias("t")).agg(
            F.count("*").alias("n"), F.count_if(F.col("size") == 1 << 40).alias("huge")).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert len(at) == 64 and sum(r.n for r in at) == 20_000
    assert max(r.n for r in at) < 700 and max(r.huge for r in at) == 1


def test_good_gguf():
    pairs = [
        ("general.architecture", 8, p.text("clip")), ("general.name", 8, p.text("N")),
        ("general.file_type", 7, b"\1"), ("llama.context_length", 10, struct.pack("<Q", 99)),
        ("arr", 9, array(4, 3, bytes(12))), ("deep", 9, nested(3)), ("active", 6, struct.pack("<f", 2.5)),
    ]
    facts = gguf.read_facts(p.gguf(pairs, [(2, 3), (), (5,)]), active_key="active")
    assert facts == {
        "general_name": "N", "basename": None, "finetune": None, "arch": "clip", "params_total": 12.0,
        "params_active": 2.5, "context_len": 99, "file_type": 1,
    }
    assert gguf.read_facts(p.gguf(version=2))["params_total"] == 0.0
    assert gguf.read_facts(p.gguf([("general.file_type", 5, struct.pack("<i", -1))]))["file_type"] is None


def listing_of(spark, root, files):
    rows = [(1, str(root), f, 1, 1, 1, 1, 1, False, None, True) for f in files]
    return spark.createDataFrame(rows, schemas.LISTING)


def test_files_are_examined(spark, tmp_path):
    big = b"GGUF" + bytes(300_000)
    st = {
        "ok.safetensors": p.safetensors({"__metadata__": {"architectures": "LlamaForCausalLM"}, "a": {"shape": [3, 4]},
                                         "b": {"shape": []}, "c": {"shape": [2, -1, 1.5]}, "d": {"x": 1}}),
        "list.safetensors": p.safetensors({"__metadata__": {"architectures": ["ClipModel", "y"]}}),
        "empty.safetensors": p.safetensors(b"{}"), "broken.safetensors": p.safetensors(b'{"a":'),
        "short.safetensors": struct.pack("<Q", 500) + b'{"a":1}',
        "notobj.safetensors": struct.pack("<Q", 2) + b"[]",
    }
    files = st | {"m.gguf": p.model(basename="m", file_type=15, tensors=[(2, 2)]), "big.gguf": big,
                  "x.onnx": b"o", "x.pt": b"p", "x.txt": b"", "_h.bin": b"12345678{"}
    p.write(tmp_path, files)
    rows = contents.examine_files(listing_of(spark, tmp_path, [*files, "absent.gguf"])).collect()
    found = {r.rel_path: r for r in rows}
    facts = {n: (r.format, r.parse_error, r.arch, r.params_total, r.kind.value if r.kind else None)
             for n, r in found.items()}
    assert facts == {
        "ok.safetensors": ("safetensors", None, "LlamaForCausalLM", 15.0, "llm"),
        "list.safetensors": ("safetensors", None, "ClipModel", None, "vision"),
        "empty.safetensors": ("safetensors", None, None, None, None),
        "broken.safetensors": ("safetensors", "safetensors.bad_json", None, None, None),
        "short.safetensors": ("safetensors", "header_too_large", None, None, None),
        "notobj.safetensors": ("unknown", "unsupported", None, None, None),
        "m.gguf": ("gguf", None, "qwen3", 4.0, "llm"),
        "big.gguf": ("gguf", "gguf.unsupported_version", None, None, None),
        "x.onnx": ("onnx", None, None, None, "unknown"), "x.pt": ("pytorch", None, None, None, "unknown"),
        "x.txt": ("unknown", "unsupported", None, None, None),
        "_h.bin": ("pytorch", None, None, None, "unknown"),
        "absent.gguf": ("unknown", "unsupported", None, None, None),
    }
    assert found["m.gguf"].quant_from_header == "Q4_K_M"
    for name, data in files.items():
        assert found[name].sha256 == hashlib.sha256(data).hexdigest()
    edges = big[:65536] + big[-65536:]
    assert found["big.gguf"].partial_digest == hashlib.sha256(edges).hexdigest()
    assert found["m.gguf"].partial_digest == found["m.gguf"].sha256
    assert found["absent.gguf"].sha256 is None


def test_verify_reports_what_changed(spark, tmp_path):
    p.write(tmp_path, {"a": b"1", "b": b"2"})
    digest = hashlib.sha256(b"1").hexdigest()
    stored = spark.createDataFrame([(1, n, digest) for n in ("a", "b", "c", "d")],
                                   "root_id long, rel_path string, sha256 string")
    chosen = listing_of(spark, tmp_path, ["a", "b", "c"])
    verdicts = {r.rel_path: r.verdict for r in contents.verify_digests(chosen, stored).collect()}
    assert verdicts == {"a": "same", "b": "different", "c": "unreadable"}

