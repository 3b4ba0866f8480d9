"""Ids of results: r: and the base64url form of file, start, end and symbol, apart by null characters."""

from __future__ import annotations

import base64
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

PREFIX, OLD_PREFIX = "r:", "symbol:"


def result_id(file: Column, start: Column, end: Column, symbol: Column | None = None) -> Column:
    parts = F.concat_ws("\0", file, start.cast("string"), end.cast("string"), F.coalesce(symbol, F.lit("")) if symbol is not None else F.lit(""))
    plain = F.regexp_replace(F.base64(F.encode(parts, "UTF-8")), r"[=\r\n]", "")
    return F.concat(F.lit(PREFIX), F.translate(plain, "+/", "-_"))


def decode_column(value: Column) -> Column:
    """struct<file, start, end, symbol> of an id, null if it is none."""
    body = F.translate(F.substring(value, len(PREFIX) + 1, 1 << 30), "-_", "+/")
    padded = F.rpad(body, (F.ceil(F.length(body) / 4) * 4).cast("int"), F.lit("="))
    parts = F.split(F.decode(F.unbase64(padded), "UTF-8"), "\0")
    decoded = F.struct(F.get(parts, 0).alias("file"), F.get(parts, 1).cast("int").alias("start"), F.get(parts, 2).cast("int").alias("end"), F.get(parts, 3).alias("symbol"))
    return F.when(F.startswith(value, F.lit(PREFIX)) & (F.size(parts) == 4), decoded)


def decode(value: str) -> dict:
    """An id on the driver, in the present or the old JSON form; ValueError for anything else and for paths that leave the root."""
    try:
        if value.startswith(OLD_PREFIX):
            raw = json.loads(_unpadded(value.removeprefix(OLD_PREFIX)))
            out = {"file": raw["file"], "start": int(raw["startLine"]), "end": int(raw["endLine"]), "symbol": raw.get("symbol", "")}
        elif value.startswith(PREFIX):
            file, start, end, symbol = _unpadded(value.removeprefix(PREFIX)).split("\0")
            out = {"file": file, "start": int(start), "end": int(end), "symbol": symbol}
        else:
            raise ValueError(value)
    except (KeyError, TypeError, UnicodeDecodeError, ValueError) as e:
        raise ValueError(f"not a result id: {value!r}") from e
    segments = out["file"].replace("\\", "/").split("/")
    if not out["file"] or segments[0] == "" or ".." in segments or ":" in segments[0] or not 1 <= out["start"] <= out["end"]:
        raise ValueError(f"not a result id: {value!r}")
    return out


def _unpadded(body: str) -> str:
    return base64.urlsafe_b64decode(body + "=" * (-len(body) % 4)).decode()
