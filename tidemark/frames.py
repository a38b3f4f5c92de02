"""Frames: numbered, timed payloads, their JSON and compact binary forms, and chunks of binary columns.

A frame is a struct (sequence, timestamp, payload); a payload has a type and the fields of that type, all
others null. Binary data travels in base64 inside JSON, vectors as arrays, so frames survive a round trip.
"""

from __future__ import annotations

import struct
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .flow import Flow
from .ordering import ranked

MESSAGE = "struct<type:string,amount:long,sequence:long,streamId:string>"
PAYLOAD = f"struct<type:string,data:binary,floats:array<float>,message:{MESSAGE},code:int,error:string,recoverable:boolean>"
FRAME = f"struct<sequence:long,timestamp:long,payload:{PAYLOAD}>"
_WIRE = FRAME.replace("data:binary", "data:string")

CHUNK = 65536
CHUNKS_A_PIECE = 10


def _payload(kind: str, **fields: Column) -> Column:
    types = {"data": "binary", "floats": "array<float>", "message": MESSAGE, "code": "int", "error": "string", "recoverable": "boolean"}
    return F.struct(F.lit(kind).alias("type"), *[(fields[n] if n in fields else F.lit(None)).cast(t).alias(n) for n, t in types.items()])


def data_payload(data: Column) -> Column:
    return _payload("data", data=data)


def float_payload(floats: Column) -> Column:
    return _payload("float32", floats=floats)


def error_payload(code: Column, message: Column, recoverable: Column) -> Column:
    return _payload("error", code=code, error=message, recoverable=recoverable)


MESSAGES = ("credit", "ack", "pause", "resume", "complete", "subscribe", "unsubscribe")


def message(kind: str, amount: Column | None = None, sequence: Column | None = None, stream: Column | None = None) -> Column:
    """A control message: credit (amount), ack (sequence), subscribe and unsubscribe (stream), pause, resume, complete."""
    if kind not in MESSAGES:
        raise ValueError(f"unknown message {kind!r}")
    null = F.lit(None)
    return F.struct(F.lit(kind).alias("type"), (amount if amount is not None else null).cast("long").alias("amount"), (sequence if sequence is not None else null).cast("long").alias("sequence"), (stream if stream is not None else null).cast("string").alias("streamId"))


def control_payload(msg: Column) -> Column:
    return _payload("control", message=msg)


def frame(payload: Column, sequence: Column, timestamp_ms: Column) -> Column:
    return F.struct(sequence.cast("long").alias("sequence"), timestamp_ms.cast("long").alias("timestamp"), payload.alias("payload"))


def is_type(frame_: Column, kind: str) -> Column:
    """Whether a frame's payload is of a type: data, float32, control or error."""
    return frame_["payload"]["type"] == kind


def numbered(flow: Flow, payload: Column, timestamp_ms: Column, name: str = "frame") -> Flow:
    """Frames of a flow's rows: sequences count from 0 along the order (in each key)."""
    rows = ranked(flow.df, flow.order, flow.key, wide=flow.wide)
    return flow.of(rows.withColumn(name, frame(payload, F.col("_rn") - 1, timestamp_ms)).drop("_rn"), value=name)


def encode(frame_: Column) -> Column:
    """A frame as UTF-8 bytes of its JSON."""
    payload = frame_["payload"]
    return F.encode(F.to_json(frame_.withField("payload", payload.withField("data", F.base64(payload["data"])))), "UTF-8")


def decode(data: Column) -> Column:
    """The frame in such bytes; bytes that are no frame give a null frame."""
    got = F.from_json(F.decode(data, "UTF-8"), _WIRE, {"mode": "PERMISSIVE"})
    payload = got["payload"]
    whole = got.withField("payload", payload.withField("data", F.unbase64(payload["data"]))).cast(FRAME)
    return F.when(got["sequence"].isNotNull() & payload.isNotNull(), whole)


_HEAD = struct.Struct(">BqqB")  # 1, sequence, timestamp, place of the type in _TYPES
_TYPES = ("data", "float32", "control", "error")


def _text(s: str | None) -> bytes:
    raw = (s or "").encode()
    return struct.pack(">i", -1 if s is None else len(raw)) + raw


def _read_text(raw: bytes, at: int) -> str | None:
    (n,) = struct.unpack_from(">i", raw, at)
    return None if n < 0 else raw[at + 4 : at + 4 + n].decode()


def _maybe(form: str, value) -> bytes:
    return b"\0" if value is None else b"\1" + struct.pack(form, value)


def pack_frame(f: dict | None) -> bytes | None:
    """A frame's bytes: a fixed head, then what its type has. None for what is no frame (a null, an unknown type, no number)."""
    p = f and f["payload"]
    if not p or f["sequence"] is None or f["timestamp"] is None or p["type"] not in _TYPES:
        return None
    kind = p["type"]
    if kind == "data":
        body = _maybe("", None) if p["data"] is None else b"\1" + bytes(p["data"])
    elif kind == "float32":
        body = _maybe("", None) if p["floats"] is None else b"\1" + b"".join(_maybe(">f", x) for x in p["floats"])
    elif kind == "control":
        m = p["message"]
        body = b"\0" if m is None else b"\1" + _text(m["type"]) + _maybe(">q", m["amount"]) + _maybe(">q", m["sequence"]) + _text(m["streamId"])
    else:
        body = _maybe(">i", p["code"]) + _text(p["error"]) + _maybe(">?", p["recoverable"])
    return _HEAD.pack(1, f["sequence"], f["timestamp"], _TYPES.index(kind)) + body


def unpack_frame(raw: bytes | None) -> dict | None:
    """The frame of such bytes; None for bytes that are none."""
    try:
        one, sequence, timestamp, kind = _HEAD.unpack_from(raw or b"")
        if one != 1:
            return None
        p = dict.fromkeys(("data", "floats", "message", "code", "error", "recoverable")) | {"type": _TYPES[kind]}
        at = _HEAD.size

        def take(form: str):
            nonlocal at
            there = raw[at]
            at += 1
            if not there:
                return None
            (value,) = struct.unpack_from(form, raw, at)
            at += struct.calcsize(form)
            return value

        def text() -> str | None:
            nonlocal at
            s = _read_text(raw, at)
            at += 4 + len((s or "").encode())
            return s

        if _TYPES[kind] == "data":
            p["data"] = raw[at + 1 :] if raw[at] else None
        elif _TYPES[kind] == "float32":
            if raw[at]:
                at += 1
                p["floats"] = []
                while at < len(raw):
                    p["floats"].append(take(">f"))
        elif _TYPES[kind] == "control":
            if raw[at]:
                at += 1
                p["message"] = {"type": text(), "amount": take(">q"), "sequence": take(">q"), "streamId": text()}
        else:
            p["code"], p["error"], p["recoverable"] = take(">i"), text(), take(">?")
        return {"sequence": sequence, "timestamp": timestamp, "payload": p}
    except (struct.error, IndexError, UnicodeDecodeError):
        return None


def _columnwise(fn: Callable, to: T.DataType):
    """fn on each element of one column, as an Arrow function."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = to_arrow_type(to)

    @F.arrow_udf(to)
    def run(a: pa.Array) -> pa.Array:
        return pa.array([fn(x) for x in a.to_pylist()], kind)

    return run


def encode_compact(frame_: Column) -> Column:
    """A frame in the compact form, or as JSON where that has no room for it (an unknown type, no timestamp)."""
    return F.coalesce(_columnwise(pack_frame, T.BinaryType())(frame_), encode(frame_))


def decode_compact(data: Column) -> Column:
    """The frame in bytes of either form; bytes that are no frame give a null frame."""
    return F.coalesce(_columnwise(unpack_frame, T._parse_datatype_string(FRAME))(data), decode(data))


def chunked(df: DataFrame, data: str, ids: list[str], size: int = CHUNK, name: str = "chunk") -> DataFrame:
    """ids, sequence (from 0), and the binary column cut into chunks of `size` bytes. Empty and null cells give none."""
    if not isinstance(size, int) or size <= 0:
        raise ValueError("a chunk needs a size above 0")
    n = F.ceil(F.octet_length(data) / size).cast("int")
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1))
    return df.select(*ids, data, F.explode(starts).alias("sequence")).select(
        *ids, F.col("sequence").cast("long").alias("sequence"), F.substring(F.col(data).cast("binary"), F.col("sequence") * size + 1, F.lit(size)).alias(name)
    )


def joined(chunks: DataFrame, ids: list[str], name: str = "chunk", pieces_of: int = CHUNKS_A_PIECE) -> DataFrame:
    """ids, piece (from 0) and the bytes of each `pieces_of` chunks in order, as they come off a wire."""
    order = F.array_sort(F.collect_list(F.struct("sequence", name)))
    bytes_ = F.aggregate(order, F.lit(b"").cast("binary"), lambda acc, x: F.concat(acc, x[name]))
    return chunks.groupBy(*ids, F.floor(F.col("sequence") / pieces_of).cast("long").alias("piece")).agg(bytes_.alias("data"))
