"""PCM wave columns: parse, write, join, trim. Arrow-batched pandas UDFs over binary columns."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

FORMAT = "channels int, sampleRate int, bitsPerSample int, audioSeconds double, data binary, error string"


def parse(raw: bytes | None) -> dict:
    """Format and samples of a RIFF/WAVE file of 16-bit PCM, or an error."""
    out = {"channels": None, "sampleRate": None, "bitsPerSample": None, "audioSeconds": None, "data": None, "error": None}
    raw = raw or b""
    if len(raw) < 44 or raw[:4] != b"RIFF" or raw[8:12] != b"WAVE":
        return out | {"error": "not a RIFF/WAVE file"}
    fmt, data, at = None, [], 12
    while at + 8 <= len(raw):
        kind, size = raw[at : at + 4], struct.unpack_from("<I", raw, at + 4)[0]
        body = raw[at + 8 : at + 8 + size]
        if len(body) < size:
            return out | {"error": f"truncated {kind.decode('latin1')} chunk"}
        if kind == b"fmt ":
            if size < 16:
                return out | {"error": "short fmt chunk"}
            fmt = struct.unpack_from("<HHIIHH", body)
        elif kind == b"data":
            data.append(body)
        at += 8 + size + size % 2
    if fmt is None or not data:
        return out | {"error": "fmt or data chunk is missing"}
    if fmt[0] != 1 or fmt[5] != 16:
        return out | {"error": "only 16-bit PCM is read"}
    joined = b"".join(data)
    return {"channels": fmt[1], "sampleRate": fmt[2], "bitsPerSample": fmt[5], "audioSeconds": len(joined) / fmt[3], "data": joined, "error": None}


def write(data: bytes, rate: int = 24_000, channels: int = 1) -> bytes:
    if len(data) % (2 * channels):
        raise ValueError("samples are not frame-aligned")
    return b"RIFF" + struct.pack("<I", 36 + len(data)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, channels, rate, rate * 2 * channels, 2 * channels, 16) + b"data" + struct.pack("<I", len(data)) + data


def from_floats(samples, rate: int = 24_000, channels: int = 1) -> bytes:
    """Samples clipped to -1 .. 1; negative ones scale by 32768, others by 32767; not-a-number is silence."""
    x = np.clip(np.nan_to_num(np.asarray(samples, np.float32).astype(float), nan=0.0, posinf=0.0, neginf=0.0), -1, 1)
    return write(np.floor(np.where(x < 0, x * 32768, x * 32767) + 0.5).astype("<i2").tobytes(), rate, channels)


def joined(files: list[bytes]) -> bytes:
    parts = [parse(f) for f in files]
    if not parts:
        raise ValueError("no audio")
    if bad := next((p["error"] for p in parts if p["error"]), None):
        raise ValueError(bad)
    kinds = {(p["channels"], p["sampleRate"], p["bitsPerSample"]) for p in parts}
    if len(kinds) > 1:
        raise ValueError("formats differ")
    return write(b"".join(p["data"] for p in parts), parts[0]["sampleRate"], parts[0]["channels"])


#: What counts as silence (absolute, and as a share of the peak), and the seconds of it that stay.
FLOOR, SHARE, MARGIN = 1e-4, 1e-3, 0.03


def trim_silence(samples, rate: int = 24_000) -> np.ndarray:
    """Samples without the quiet at both ends but for a margin; all of them if nothing is loud."""
    x = np.ravel(np.asarray(samples, np.float32))
    level = np.abs(x)
    loud = level >= max(FLOOR, SHARE * float(level.max(initial=0)))
    if not loud.any():
        return x
    quiet = [max(0, int(side.argmax()) - int(MARGIN * rate)) for side in (loud, loud[::-1])]
    return x[quiet[0] : len(x) - quiet[1]]


def parse_wave(c):
    def run(x: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([parse(v) for v in x])

    return F.pandas_udf(run, FORMAT)(c)


def floats_to_wave(c):
    def run(x: pd.Series) -> pd.Series:
        return x.map(from_floats)

    return F.pandas_udf(run, "binary")(c)


def trimmed(c, rate: int = 24_000):
    def run(x: pd.Series) -> pd.Series:
        return x.map(lambda v: trim_silence(v, rate).tolist())

    return F.pandas_udf(run, "array<float>")(c)


def join_waves(df, key: str, order: str, audio: str):
    """One file for each key, its parts in order."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({key: [pdf[key].iloc[0]], "audio": [joined(pdf.sort_values(order)[audio].tolist())]})

    return df.groupBy(key).applyInPandas(run, f"{key} {df.schema[key].dataType.simpleString()}, audio binary")
