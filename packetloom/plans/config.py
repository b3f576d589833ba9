"""Options of a decode."""

from __future__ import annotations

from dataclasses import dataclass

MODES = ("permissive", "strict")


@dataclass(frozen=True)
class ParseConfig:
    max_ipv6_extension_headers: int = 8
    max_mpls_labels: int = 8
    mode: str = "permissive"
    #: False: the Ethernet header is all that is read. Bytes that are no capture have no tags, no
    #: cooked header and no packet behind it; whatever stands at byte 12 is unsupported.
    payloads: bool = True

    def __post_init__(self):
        if self.mode not in MODES:
            raise ValueError(f"mode is one of {MODES}")

    @property
    def strict(self) -> bool:
        return self.mode == "strict"


@dataclass(frozen=True)
class DecodeConfig:
    """Of the plug-in path; only max_packet_bytes limits anything."""

    mode: str = "permissive"
    max_depth: int = 8
    max_packet_bytes: int = 65_535
