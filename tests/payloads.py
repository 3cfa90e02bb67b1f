"""Writers of small model files for the tests."""

import json
import struct
from pathlib import Path

ACTIVE_KEY = "test.params_active"


def text(value: str) -> bytes:
    raw = value.encode()
    return struct.pack("<Q", len(raw)) + raw


def pair(key: str, tag: int, value: bytes) -> bytes:
    return text(key) + struct.pack("<I", tag) + value


def gguf(pairs=(), tensors=(), version=3) -> bytes:
    """`pairs` are (key, tag, encoded value); `tensors` are shapes."""
    out = b"GGUF" + struct.pack("<IQQ", version, len(tensors), len(pairs))
    for key, tag, value in pairs:
        out += pair(key, tag, value)
    for i, shape in enumerate(tensors):
        out += text(f"t{i}") + struct.pack("<I", len(shape))
        out += b"".join(struct.pack("<Q", d) for d in shape) + struct.pack("<IQ", 0, 0)
    return out


def model(arch="qwen3", basename=None, name=None, file_type=None, active=None, tensors=(), extra=()):
    pairs = [] if arch is None else [("general.architecture", 8, text(arch))]
    if basename is not None:
        pairs.append(("general.basename", 8, text(basename)))
    if name is not None:
        pairs.append(("general.name", 8, text(name)))
    if file_type is not None:
        pairs.append(("general.file_type", 4, struct.pack("<I", file_type)))
    if active is not None:
        pairs.append((ACTIVE_KEY, 12, struct.pack("<d", active)))
    return gguf([*pairs, *extra], tensors)


def safetensors(header, body: int = 64) -> bytes:
    raw = header if isinstance(header, bytes) else json.dumps(header).encode()
    return struct.pack("<Q", len(raw)) + raw + b"\0" * body


def write(root: Path, files: dict[str, bytes]) -> Path:
    for rel, data in files.items():
        path = root / rel
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(data)
    return root
