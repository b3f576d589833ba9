"""Plug-in dissectors: the one whose probe has the highest priority decodes a frame.

A dissector's probe and decode take the frame's Column and give Columns, so plug-ins run
inside the plan like everything else.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from packetloom.plans.config import DecodeConfig

EVENTS = "array<struct<protocol: string, offset: int, length: int, message: string>>"


def event(protocol: str, offset: Column, length: Column, message: str = "") -> Column:
    return F.struct(F.lit(protocol).alias("protocol"), offset.cast("int").alias("offset"), length.cast("int").alias("length"), F.lit(message).alias("message"))


@dataclass(frozen=True)
class Dissector:
    """probe: a priority 0 to 255, or NULL for no match. decode: an array of events."""

    name: str
    probe: Callable[[Column], Column]
    decode: Callable[[Column], Column]


@dataclass
class Registry:
    dissectors: list[Dissector] = field(default_factory=list)

    def register(self, dissector: Dissector) -> Registry:
        self.dissectors.append(dissector)
        return self

    def __len__(self) -> int:
        return len(self.dissectors)

    def best(self, frame: Column) -> Column:
        """Number of the dissector with the highest priority, the first registered of equals;
        NULL if none matches."""
        if not self.dissectors:
            return F.lit(None).cast("int")
        found = [F.when(d.probe(frame).isNotNull(), F.struct(d.probe(frame).cast("int").alias("priority"), F.lit(-i).alias("order"))) for i, d in enumerate(self.dissectors)]
        return -F.array_max(F.array_compact(F.array(*found)))["order"]

    def decode(self, frame: Column, config: DecodeConfig = DecodeConfig()) -> Column:
        """(matched, events, error) of a frame; error: (kind, needed, available) of a frame
        over the limit, which is not decoded."""
        size = F.length(frame)
        large = size > config.max_packet_bytes
        error = F.when(large, F.struct(F.lit("InsufficientBytes").alias("kind"), size.alias("needed"), F.lit(config.max_packet_bytes).alias("available")))

        def chosen(best: Column) -> Column:
            name, events = F.lit(None).cast("string"), F.array().cast(EVENTS)
            for i, d in enumerate(self.dissectors):
                name = F.when(best == i, d.name).otherwise(name)
                events = F.when(best == i, d.decode(frame).cast(EVENTS)).otherwise(events)
            return F.struct(name.alias("matched"), events.alias("events"), error.alias("error"))

        return F.get(F.transform(F.array(F.when(~large, self.best(frame))), chosen), F.lit(0))


def decode_error_text(kind: Column, protocol: Column, needed: Column, available: Column) -> Column:
    """The text of an error of the plug-in path. protocol: of a malformed header or an
    unsupported protocol; needed: bytes, or the depth of a decode over its limit."""
    text = lambda x: F.coalesce(x.cast("string"), F.lit(""))
    return (
        F.when(kind == "MalformedHeader", F.concat(F.lit("Malformed header for protocol: "), text(protocol)))
        .when(kind == "InsufficientBytes", F.concat(F.lit("Insufficient bytes: needed "), text(needed), F.lit(", available "), text(available)))
        .when(kind == "UnsupportedProtocol", F.concat(F.lit("Unsupported protocol: "), text(protocol)))
        .when(kind == "DepthLimitExceeded", F.concat(F.lit("Decode depth limit exceeded: "), text(needed)))
    )


def error_text(error: Column) -> Column:
    """Of the error that ``Registry.decode`` gives."""
    return decode_error_text(error["kind"], F.lit(None).cast("string"), error["needed"], error["available"])
