"""Arrays in files of the shared folder, written whole by a task and memory-mapped by others."""

from __future__ import annotations

import json
import mmap
import uuid
from functools import lru_cache

import numpy as np
from pyarrow import fs

from swarmscope.llm.elias_fano import EliasFano


def place(uri: str) -> tuple[fs.FileSystem, str]:
    uri = uri.replace("s3a://", "s3://", 1)
    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


def write_bytes(uri: str, parts: list[bytes]) -> None:
    """The file appears whole or not at all; a repeated attempt replaces it by the same bytes."""
    system, path = place(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    draft = f"{path}.{uuid.uuid4().hex}"
    with system.open_output_stream(draft) as out:
        for part in parts:
            out.write(part)
    system.move(draft, path)


def read_bytes(uri: str) -> memoryview:
    """Memory-mapped where the folder is mounted, else read."""
    system, path = place(uri)
    if isinstance(system, fs.LocalFileSystem):
        with open(path, "rb") as f:
            return memoryview(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))
    with system.open_input_file(path) as f:
        return memoryview(f.read())


def write_arrays(uri: str, arrays: dict[str, np.ndarray | EliasFano], **numbers: int) -> None:
    """A header in JSON, then the arrays, each from a multiple of 8 bytes on."""
    flat: dict[str, np.ndarray] = {}
    for name, x in arrays.items():
        if isinstance(x, EliasFano):
            numbers |= {f"{name}.{k}": getattr(x, k) for k in ("n", "universe", "width", "sample")}
            flat |= {f"{name}.{k}": getattr(x, k) for k in ("low", "high", "samples")}
        else:
            flat[name] = x
    about = json.dumps({"numbers": numbers, "arrays": [[k, x.dtype.str, len(x)] for k, x in flat.items()]}).encode()
    about += b" " * (-len(about) % 8)
    parts = [np.array([len(about)], "<u8").tobytes(), about]
    for x in flat.values():
        parts += [x.tobytes(), bytes(-x.nbytes % 8)]
    write_bytes(uri, parts)


def map_arrays(uri: str) -> dict:
    """What ``write_arrays`` wrote, as views. The worker process keeps the last files: mapped ones cost it no memory of its
    own, but where the folder is not mounted they are read whole."""
    return mapped_arrays(uri) if mounted(uri) else read_arrays(uri)


@lru_cache(maxsize=512)
def mapped_arrays(uri: str) -> dict:
    return arrays_of(uri)


@lru_cache(maxsize=16)
def read_arrays(uri: str) -> dict:
    return arrays_of(uri)


def mounted(uri: str) -> bool:
    return "://" not in uri or uri.startswith("file:")


def arrays_of(uri: str) -> dict:
    data = read_bytes(uri)
    size = int(np.frombuffer(data, "<u8", 1)[0])
    about = json.loads(bytes(data[8 : 8 + size]))
    out: dict = dict(about["numbers"])
    at = 8 + size
    for name, kind, n in about["arrays"]:
        out[name] = np.frombuffer(data, kind, n, at)
        at += -(-out[name].nbytes // 8) * 8
    for name in {k[: -len(".low")] for k in out if k.endswith(".low")}:
        out[name] = EliasFano(*[out[f"{name}.{k}"] for k in ("n", "universe", "width", "sample", "low", "high", "samples")])
    return out
